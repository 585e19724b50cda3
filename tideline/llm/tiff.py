"""TIFF pages in binary columns.

``encode_tiff`` stores bytes as 8-bit grey pages; ``walk`` reads any little- or
big-endian file of 8-bit grey or RGB samples: it follows the chain of image
directories, decodes PackBits, LZW or deflate strips and tiles, undoes the
horizontal predictor, and gives one page after the other.

Null payloads count as empty. A file that is no TIFF, is cut short, damaged,
larger than ``MOST_SAMPLES`` a page or uses an unknown compression has its
``error`` in a row; it never fails the job, and no sample is given that the file doesn't hold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import slices

#: Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
COMPRESSIONS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}
SIZE_OF = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 284, 317, 322, 323, 324, 325

#: Payload bytes are padded to a multiple of UNIT; pages are ROW samples wide.
UNIT, ROW, PAGE_ROWS, ROWS_PER_STRIP = 576, 576, 256, 64
#: Samples of a page at most; a page that claims more is an error.
MOST_SAMPLES = 1 << 28
#: (compression, predictor, side of a tile or 0 for strips): the forms that the payload's checksum chooses from.
FORMS = [("deflate", 2, 0), ("lzw", 2, 0), ("packbits", 1, 0), ("deflate", 2, 64)]
#: What damaged files raise.
DAMAGE = (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error)


@dataclass
class Page:
    index: int
    width: int
    height: int
    compression: int
    predictor: int
    samples: np.ndarray  # height x width x samples per pixel, 8 bits


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three or more equal bytes as repeats, the rest as literals."""
    raw = np.frombuffer(data, np.uint8)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(raw)) + 1, [len(raw)]]) if len(raw) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(begin) >= 3)
    out, at = bytearray(), 0
    for start, end in [*zip(begin[long].tolist(), begin[long + 1].tolist(), strict=True), (len(data), len(data))]:
        for i in range(at, start, 128):
            part = data[i : min(i + 128, start)]
            out.append(len(part) - 1)
            out += part
        while end - start >= 3:
            run = min(128, end - start)
            out += bytes([257 - run, data[start]])
            start += run
        at = start  # one or two that are left are literals
    return bytes(out)


def unpack_bits(data: bytes, most: int) -> bytes:
    """At most about ``most`` bytes."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
                i += 2
            else:
                i += 1
    return bytes(out)


#: Codes between two clear codes: their widths, and where their bits end.
_FULL = 4094 - 257
_WIDTHS = np.searchsorted([511, 1023, 2047], np.arange(257, 257 + _FULL + 2), "right") + 9
_BITS = np.cumsum(_WIDTHS)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, width raised when code 511, 1023 or 2047 is due, cleared when code 4094 is."""
    runs: list[list[int]] = [[]]
    codes, table, next_code, word = runs[0], {}, 258, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        pair = word << 8 | byte
        known = table.get(pair)
        if known is not None:
            word = known
            continue
        codes.append(word)
        table[pair] = next_code
        next_code += 1
        word = byte
        if next_code == 4095:
            codes.append(256)
            codes, table, next_code = [], {}, 258
            runs.append(codes)
    if word >= 0:
        codes.append(word)
    codes.append(257)
    first = True
    bits = []
    for run in runs:  # the file begins with a clear code, of 9 bits; others end the run before them
        bits += [_bits_of(np.array([256]), np.array([9]))] if first else []
        bits.append(_bits_of(np.array(run, np.int64), _WIDTHS[: len(run)]))
        first = False
    return np.packbits(np.concatenate(bits)).tobytes()


def _bits_of(codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The codes' bits, high bit first, one per element."""
    shift = widths[:, None] - 1 - np.arange(12)
    return (codes[:, None] >> np.maximum(shift, 0) & 1)[shift >= 0].astype(np.uint8)


def lzw_decode(data: bytes, most: int) -> bytes:
    """At most about ``most`` bytes. Widths depend on a code's number since the last clear code only, so codes are cut out together."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    out, size, at = [], 0, 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    while size < most:
        n = int(np.searchsorted(_BITS, len(bits) - at, "right"))
        if not n:
            break
        ends = at + _BITS[:n]
        codes = np.zeros(n, np.int64)
        for k in range(12):
            here = _WIDTHS[:n] > k
            codes[here] |= bits[ends[here] - 1 - k].astype(np.int64) << k
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        used = int(stop[0]) if len(stop) else n
        table, word = list(base), b""
        for code in codes[:used].tolist():
            if code < len(table):
                entry = table[code]
            elif word and code == len(table):
                entry = word + word[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            size += len(entry)
            if word:
                table.append(word + entry[:1])
            word = entry
            if size >= most:
                break
        if not len(stop):
            if n == len(_BITS):
                raise ValueError("an LZW table is full")
            break
        if codes[used] == 257:
            break
        at = int(ends[used])
    return b"".join(out)


def _pack(raw: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(raw, 1)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: pack_bits}[compression](raw)


def _unpack(raw: bytes, compression: int, size: int) -> bytes:
    """``size`` bytes; what a block holds beyond them isn't unpacked."""
    if compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(raw, size)
    elif compression in (LZW, PACKBITS):
        out = {LZW: lzw_decode, PACKBITS: unpack_bits}[compression](raw, size)
    elif compression == NONE:
        out = raw
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(out) < size:
        raise ValueError("a block is too short")
    return out[:size]


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return payload + b"\xff" * (-len(payload) % UNIT or (0 if payload else UNIT))


def encode_tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tile: int = 0) -> bytes:
    """A little-endian file of grey pages, ROW samples wide and PAGE_ROWS high at most. ``tile``: its side, a multiple of 16; 0: strips."""
    grey = np.frombuffer(pad(payload), np.uint8).reshape(-1, ROW)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(grey), PAGE_ROWS):
        page = grey[top : top + PAGE_ROWS]
        if tile:
            page = np.pad(page, ((0, -len(page) % tile), (0, -ROW % tile)))
            blocks = [page[y : y + tile, x : x + tile] for y in range(0, len(page), tile) for x in range(0, page.shape[1], tile)]
        else:
            blocks = [page[y : y + ROWS_PER_STRIP] for y in range(0, len(page), ROWS_PER_STRIP)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], 1)
            packed = _pack(block.tobytes(), compression)
            places.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        arrays = []
        for values in (places, sizes):
            arrays.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        high = min(PAGE_ROWS, len(grey) - top)
        tags = [(WIDTH, 3, 1, ROW), (HEIGHT, 3, 1, high), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1)]
        tags += [(SAMPLES, 3, 1, 1)] if tile else [(STRIPS, 4, len(places), arrays[0]), (SAMPLES, 3, 1, 1), (STRIP_ROWS, 3, 1, ROWS_PER_STRIP), (STRIP_BYTES, 4, len(sizes), arrays[1])]
        tags += [(PREDICTOR, 3, 1, predictor)]
        tags += [(TILE_WIDTH, 3, 1, tile), (TILE_HEIGHT, 3, 1, tile), (TILES, 4, len(places), arrays[0]), (TILE_BYTES, 4, len(sizes), arrays[1])] if tile else []
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def walk(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its image directories."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:1] == b"I" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a circle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            place = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            if kind not in CODES:
                continue
            if count * SIZE_OF[kind] > 4:
                (start,) = struct.unpack_from(order + "I", data, place + 8)
            else:
                start = place + 8
            if start + count * SIZE_OF[kind] > len(data):
                raise ValueError("a tag lies outside the file")
            if count:
                tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, start)
        yield _page(data, tags, len(seen) - 1)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, tags: dict[int, tuple[int, ...]], index: int) -> Page:
    def one(tag: int, default: int) -> int:
        return tags.get(tag, (default,))[0]

    width, height, per = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if min(width, height, per) < 1:
        raise ValueError("a page has no size")
    if width * height * per > MOST_SAMPLES:
        raise ValueError("a page is too large")
    if set(tags.get(BITS, (8,))) != {8} or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only interleaved 8-bit samples with predictor 1 or 2 are supported")
    tiled = TILES in tags
    if tiled:
        wide, high = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
    else:
        wide, high = width, min(height, one(STRIP_ROWS, height))
    if min(wide, high) < 1:
        raise ValueError("a block has no size")
    places, sizes = (tags.get(t, ()) for t in ((TILES, TILE_BYTES) if tiled else (STRIPS, STRIP_BYTES)))
    across, down = -(-width // wide), -(-height // high)
    if across * wide * down * high * per > MOST_SAMPLES:
        raise ValueError("a page's blocks are too large")
    if len(places) != len(sizes) or len(places) < across * down:
        raise ValueError("a page lacks blocks")
    image = np.zeros((down * high, across * wide, per), np.uint8)
    for k, (place, size) in enumerate(zip(places[: across * down], sizes, strict=False)):
        if place + size > len(data):
            raise ValueError("a block lies outside the file")
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        block = np.frombuffer(_unpack(data[place : place + size], compression, rows * wide * per), np.uint8).reshape(rows, wide, per)
        image[y : y + rows, x : x + wide] = np.cumsum(block, axis=1, dtype=np.uint8) if predictor == 2 else block
    return Page(index, width, height, compression, predictor, image[:height, :width])


def page_feature(samples: np.ndarray) -> str:
    """Width, height, floor of the mean, and a 64-bit hash: which of 8 x 8 areas lie above the mean."""
    grey = samples.reshape(len(samples), -1)
    total, cells = int(grey.sum(dtype=np.int64)), grey.size
    ys, xs = np.arange(8) * len(grey) // 8, np.arange(8) * grey.shape[1] // 8
    heights = np.diff(np.append(ys, len(grey)))
    rows = np.add.reduceat(grey, xs, axis=1, dtype=np.int64)
    sums = np.stack([rows[y : y + max(h, 1)].sum(0) for y, h in zip(ys, heights, strict=True)])
    counts = np.maximum(heights, 1)[:, None] * np.diff(np.append(xs, grey.shape[1]))
    bits = (sums * cells > total * counts).ravel()
    return f"{grey.shape[1]}x{len(grey)}/{total // cells}/{np.packbits(bits).tobytes().hex()}"


def to_tiff(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("doc_id",), forms: list[tuple[str, int, int]] = FORMS) -> DataFrame:
    """The columns ``keep``, n_bytes of the payload (string or binary; null: none) and ``media``, the TIFF file, in the form that the payload's CRC-32 chooses."""
    fields = df.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_bytes long, media binary"])
    coded = [(COMPRESSIONS[c], p, t) for c, p, t in forms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__payload"):
            raw = [x or b"" for x in b.column("__payload").to_pylist()]
            media = [encode_tiff(x, *coded[zlib.crc32(x) % len(coded)]) for x in raw]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(fields))), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], [*(f.name for f in fields), "n_bytes", "media"])

    return df.select(*keep, F.col(payload).cast("binary").alias("__payload")).mapInArrow(run, schema)


def tiff_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page: ``keep``, page, width, height, compression, predictor, samples, feature, error.

    A file that can't be read gives one row with page null and an error; null media give no row.
    """
    fields = df.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["page int, width int, height int, compression int, predictor int, samples binary, feature string, error string"])
    names = [*(f.name for f in fields), "page", "width", "height", "compression", "predictor", "samples", "feature", "error"]
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__media"):
            rows, of = [], []
            for i, x in enumerate(b.column("__media").to_pylist()):
                if x is None:
                    continue
                try:
                    for p in walk(x):
                        rows.append((p.index, p.width, p.height, p.compression, p.predictor, p.samples.tobytes(), page_feature(p.samples), None))
                        of.append(i)
                except DAMAGE as e:
                    rows.append((None, None, None, None, None, None, None, str(e) or type(e).__name__))
                    of.append(i)
            kept = b.take(pa.array(of, pa.int64()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(fields))), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return df.select(*keep, F.col(media).alias("__media")).mapInArrow(run, schema)


def tiff_digests(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """One row per file, folded from its pages as they are walked: ``keep``, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_pages, error.

    A file that can't be read has the columns of its stored form and an error; null media have nulls only.
    """
    fields = df.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int, error string"])
    names = [*(f.name for f in fields), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__media"):
            rows = []
            for x in b.column("__media").to_pylist():
                if x is None:
                    rows.append((None,) * 8)
                    continue
                pages, digest, size, tail, feature = 0, hashlib.sha256(), 0, b"", []
                stored = len(x), hashlib.sha256(x).hexdigest()
                try:
                    for p in walk(x):
                        raw = p.samples.tobytes()
                        digest.update(raw)
                        size, tail, pages = size + len(raw), (tail + raw[-32:])[-32:], pages + 1
                        feature.append(page_feature(p.samples))
                except DAMAGE as e:
                    rows.append((None, None, None, *stored, None, None, str(e) or type(e).__name__))
                    continue
                rows.append((size, digest.hexdigest(), zlib.crc32(tail), *stored, ";".join(feature), pages, None))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(fields))), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return df.select(*keep, F.col(media).alias("__media")).mapInArrow(run, schema)
