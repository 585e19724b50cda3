"""Token ids as files of Huffman codes, in the order of document ids.

Texts are encoded once and their ids written; all ids are counted, and from the
global counts a canonical Huffman code is made whose words have at most
``LIMIT`` bits (package-merge). The documents are then dealt by ranges of their
ids, sorted, and each task writes what it has as file images of about
``IMAGE_IDS`` ids, one a row of a Parquet table, so that Spark's committer makes
them whole and any file system that Spark reaches can hold them.

An image holds its own code lengths, the documents' ids and numbers of tokens,
and blocks of ``BLOCK`` ids. A block begins on a byte, needs no other block, and
has a bit offset for every ``STEP`` ids. Decoding reads ``LIMIT`` bits at a time
and looks symbol and length up in one table, for all checkpoints side by side;
a part of an image is read from the checkpoint before it.

A null text is an empty one and has the end id only, if one is asked for. Null
ids of documents come first; rows with one id are in the order of their ids'
hash, so equal rows may change places with each other only. An empty table
gives no file and no row. A text of any length is in one image, which is as
long as it needs to be. Columns besides key and text aren't read, so that their
names don't matter. Ids are numbered over all files: where a
part begins is the sum of the parts before it, added up in two levels.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import scratch
from tideline.llm.batches import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
#: Most bits of a code; more where the ids wouldn't fit.
LIMIT = 16
#: Ids of a block, of a checkpoint, of a file image.
BLOCK, STEP, IMAGE_IDS = 1 << 16, 1 << 10, 1 << 20
#: Bytes of ids in a range of documents.
PART_BYTES = 64 << 20
#: Distinct words that a worker remembers (about 75 MB); of a full memory those stay that were met again. Words that are encoded together.
REMEMBERED, TOGETHER = 450_000, 64
#: Bytes of texts that are encoded together.
ENCODED_BYTES = 4 << 20
#: Ranges whose beginnings may be broadcast (16 bytes each).
MOST_PARTS = 1 << 20
#: Words that the tokenizer's normalisation leaves alone (lower-case Latin), and its pattern of their parts.
_SIMPLE = re.compile(r"[!-@\[-~ß-öø-ÿ]+")
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_MAGIC = b"TIDEHUF1"


class Known(dict):
    """Numbers for keys; unknown keys get the next one and are put on a list."""

    def __init__(self, known=()) -> None:
        super().__init__(known)
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case and drops white space, so that a text's ids are its words' ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None  # lower-case ASCII is in normal form
        vocabulary = self.plain.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.flat, self.start, self.length = Known(), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the words that were met more than once, unless these are most."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > REMEMBERED // 2:
            kept = kept[:0]
        words, lengths = list(self.known), self.length[kept]
        self.known = Known(zip(map(words.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(self.start[kept] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.start, self.length, self.uses = ends - lengths, lengths, np.zeros(len(kept), np.int64)

    def _simple(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of each word's) of words that ``_SIMPLE`` matches, in one go; their parts by the tokenizer's pattern tell the words apart."""
        parts = [1 if w.isalpha() else len(_PARTS.findall(w)) for w in words]
        ids = np.array(self.plain.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != sum(parts):
            return None
        return ids, np.diff(ends[np.cumsum(parts) - 1], prepend=0)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words; where tokens begin tells the words apart."""
        got = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        begin = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        where = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(got))[::2]
        return np.array(got.ids, np.int32), np.bincount(np.searchsorted(begin, where, "right") - 1, minlength=len(words))

    def _learn(self) -> None:
        words, self.known.new = self.known.new, []
        simple = np.array([bool(_SIMPLE.fullmatch(w)) and "<|" not in w for w in words], bool)
        ids: list[np.ndarray] = []
        lengths = np.zeros(len(words), np.int64)
        order = []
        for plain, which in ((True, np.flatnonzero(simple)), (False, np.flatnonzero(~simple))):
            for at in range(0, len(which), TOGETHER):
                some = which[at : at + TOGETHER]
                several = [words[i] for i in some.tolist()]
                found = (self._simple(several) if plain else None) or self._other(several)
                ids.append(found[0])
                lengths[some] = found[1]
                order.append(some)
        order = np.concatenate(order)
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(lengths[order]) - lengths[order] + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def encode(self, several: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        lower = pc.replace_substring_regex(pc.ascii_lower(several), "([a-z])([.,;:!?]+)(\\s)", "\\1 \\2\\3")  # what ends a clause is a word of its own
        special = pc.match_substring(several, "<|")  # a special token counts in its own case only
        if pc.any(special).as_py():
            lower = pc.if_else(special, several, lower)
        words = pc.ascii_split_whitespace(lower)
        counts = words.value_lengths().to_numpy()
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.empty(0, np.int32), np.zeros(len(several), np.int64)
        distinct = _strings(coded.dictionary)
        index = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if self.known.new:
            self._learn()
        self.uses += np.bincount(index, minlength=len(self.uses))
        lengths = self.length[index]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[index] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(edges)


def _strings(words: pa.StringArray) -> list[str]:
    """A list of words without white space, by way of one text."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, "\n")[0].as_py().split("\n")


class TextEncoder:
    """Ids of texts by any tokenizer, a text at a time."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, several: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.int32) for x in several.to_pylist()]
        return np.concatenate([np.empty(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)


@lru_cache(maxsize=1)
def _encoder(path: str, by_words: bool) -> WordEncoder | TextEncoder:
    return (WordEncoder if by_words else TextEncoder)(path)


def encode_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = None, by_words: bool = False) -> DataFrame:
    """(key, ids): a text's ids as unsigned numbers of 16 or 32 bits, little endian, ``end`` after them.

    ``by_words``: the tokenizer lowers case and drops white space, so each distinct word is encoded once by a worker.
    """
    kind = _kind(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, by_words)
        for b in slices(batches, "__text", ENCODED_BYTES):
            ids, counts = coder.encode(pc.fill_null(b.column(1), ""))
            if end is not None:
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
            column = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([b.column(0), column.cast(pa.binary())], [key, "ids"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` long, ids binary")


def _kind(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def count_ids(coded: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id stands in all rows of ``ids``."""
    kind = _kind(n_ids)
    itemsize = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            column = b.column(0).cast(pa.large_binary())
            edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(column.buffers()[2] or b"", kind)[edges[0] // itemsize : edges[-1] // itemsize]
            for at in range(0, len(ids), 1 << 20):
                total += np.bincount(ids[at : at + (1 << 20)], minlength=n_ids)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    out = np.zeros(n_ids, np.int64)
    for r in coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id of the tokenizer
        out[r["id"]] = r["n"]
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for those that don't occur: the best code with words of ``limit`` bits at most, by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    some = np.flatnonzero(counts)
    if len(some) < 2:
        lengths[some] = 1
        return lengths
    limit = max(limit, int(len(some) - 1).bit_length())
    order = some[np.argsort(counts[some], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        every = np.concatenate([weight, packages])
        by_weight = np.argsort(every, kind="stable")
        levels.append(by_weight < len(weight))
        every = every[by_weight]
        packages = every[: len(every) // 2 * 2].reshape(-1, 2).sum(1)
    need = 2 * (len(some) - 1)
    for single in reversed(levels):
        n = int(single[:need].sum())
        lengths[order[:n]] += 1
        need = 2 * (need - n)
    return lengths


class Code:
    """The canonical code of code lengths: shorter words first, equal ones by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(lengths.max(initial=0)))
        some = np.flatnonzero(lengths)
        some = some[np.argsort(self.lengths[some], kind="stable")]
        room = 1 << (self.bits - self.lengths[some])
        first = np.cumsum(room) - room
        self.words = np.zeros(len(lengths), np.uint64)
        self.words[some] = (first >> (self.bits - self.lengths[some])).astype(np.uint64)
        self.table = np.zeros(1 << self.bits, np.int64)  # symbol * 64 + length; codes that none has are of one bit
        self.table[:] = 1
        self.table[: int(room.sum())] = np.repeat(some << 6 | self.lengths[some], room)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits of a block, filled up to a byte; the bit where each STEP-th id begins)."""
        size, word = self.lengths[ids], self.words[ids]
        ends = np.cumsum(size)
        checkpoints = (ends - size)[::STEP].astype(np.uint32)
        total = int(ends[-1]) if len(ends) else 0
        while 2 * int(size.max(initial=0)) <= 64 and len(size) > 1:  # pairs of words become one
            if len(size) % 2:
                size, word = np.append(size, 0), np.append(word, np.uint64(0))
            word = word[::2] << size[1::2].astype(np.uint64) | word[1::2]
            size = size[::2] + size[1::2]
        size, word = size[size > 0], word[size > 0]
        begin = np.cumsum(size) - size
        at, shift = begin >> 6, (begin & 63).astype(np.uint64)
        out = np.zeros(total // 64 + 2, np.uint64)
        if len(size):
            word = word << (64 - size).astype(np.uint64)
            runs = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[runs]] |= np.bitwise_or.reduceat(word >> shift, runs)
            rest = np.where(shift > 0, word << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            out[at[runs] + 1] |= np.bitwise_or.reduceat(rest, runs)
        return out.astype(">u8").tobytes()[: -(-total // 8)], checkpoints

    def unpack(self, data: bytes, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids from bit positions ``begin`` on, ``n`` of each, all positions side by side."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.int64)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        place, last, mask = begin.astype(np.int64), 8 * len(data), (1 << self.bits) - 1
        steps = int(n.max(initial=0))
        out = np.zeros((steps, len(n)), np.int32)
        for k in range(steps):
            entry = self.table[window[place >> 3] >> (32 - self.bits - (place & 7)) & mask]
            out[k] = entry >> 6
            place = np.minimum(place + (entry & 63), last)
        return out.T[np.arange(steps) < n[:, None]]


def to_image(keys: list[int | None], counts: np.ndarray, ids: np.ndarray, code: Code, lengths: bytes) -> bytes:
    """A file image: magic, header, code lengths, document ids and counts, block index, checkpoints, blocks."""
    blocks = [code.pack(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    names = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    nulls = np.packbits(np.array([k is None for k in keys], bool)).tobytes()
    sizes = np.array([len(b) for b, _ in blocks], "<u4").tobytes()
    marks = np.concatenate([np.empty(0, np.uint32), *(c for _, c in blocks)]).astype("<u4").tobytes()
    index = zlib.compress(b"".join([names, nulls, counts.astype("<i8").tobytes(), sizes, marks]), 1)
    head = struct.pack("<8sIIIQQ", _MAGIC, len(lengths), len(index), len(blocks), len(keys), len(ids))
    return b"".join([head, lengths, index, *(b for b, _ in blocks)])


class Image:
    """A file image that is read."""

    def __init__(self, data: bytes):
        magic, n_lengths, n_index, blocks, docs, self.n_ids = struct.unpack_from("<8sIIIQQ", data)
        if magic != _MAGIC:
            raise ValueError("no token file")
        at = struct.calcsize("<8sIIIQQ")
        self.code = _code(bytes(data[at : at + n_lengths]))
        index = zlib.decompress(data[at + n_lengths : at + n_lengths + n_index])
        self.payload = bytes(data[at + n_lengths + n_index :])
        cut = np.cumsum([0, 8 * docs, -(-docs // 8), 8 * docs, 4 * blocks, len(index)])
        names, nulls, counts, sizes, marks = (index[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
        void = np.unpackbits(np.frombuffer(nulls, np.uint8))[:docs].astype(bool)
        self.keys = pa.array(np.frombuffer(names, "<i8"), mask=void)
        self.counts = np.frombuffer(counts, "<i8")
        size = np.frombuffer(sizes, "<u4").astype(np.int64)
        marks = np.frombuffer(marks, "<u4").astype(np.int64)
        block = np.arange(len(marks)) * STEP // BLOCK
        self.begin = marks + 8 * (np.cumsum(size) - size)[block]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids ``first`` to ``last``, decoded from the checkpoints around them."""
        last = self.n_ids if last is None else last
        a, b = first // STEP, -(-last // STEP)
        n = np.minimum(STEP, self.n_ids - np.arange(a, b) * STEP)
        return self.code.unpack(self.payload, self.begin[a:b], n)[first - a * STEP : last - a * STEP]


@lru_cache(maxsize=2)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(zlib.decompress(lengths), np.uint8))


def write_token_files(coded: DataFrame, n_ids: int, key: str = "doc_id", part_bytes: int = PART_BYTES, image_ids: int = IMAGE_IDS, limit: int = LIMIT) -> DataFrame:
    """The table of file images, in ascending order of (part, seq): part, seq, before (ids of the part's files before), n_docs, n_ids, image.

    ``coded``: a written table of (key, ids), as ``encode_ids`` gives it.
    """
    kind = _kind(n_ids)
    lengths = zlib.compress(code_lengths(count_ids(coded, n_ids), limit).tobytes(), 9)
    total = coded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // part_bytes))
    # equal keys are told apart by their ids, and equal rows by their place in the written table, so that no key fills a range
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    order = [F.col(key), F.xxhash64("ids"), F.col("__place")]
    dealt = coded.withColumn("__place", place).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(key, "ids")
    names = ["part", "seq", "before", "n_docs", "n_ids", "image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq, before = _code(lengths), TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            nonlocal seq, before, keys, held
            counts = np.array([len(x) for x in held], np.int64)
            data = to_image(keys, counts, np.concatenate([np.empty(0, kind), *held]), code, lengths)
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, before, len(keys), int(counts.sum()), data)], names)
            seq, before, keys, held = seq + 1, before + int(counts.sum()), [], []
            return out

        n = 0
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.empty(0, kind)
                if held and n + len(ids) > image_ids:
                    yield image()
                    n = 0
                keys.append(k)
                held.append(ids)
                n += len(ids)
            held = [x.copy() for x in held]  # don't keep the whole batch
        if held:
            yield image()

    return scratch.table(dealt.mapInArrow(run, "part long, seq long, before long, n_docs long, n_ids long, image binary"), "token-files")


def part_starts(files: DataFrame, run: int = 1024) -> DataFrame:
    """(part, start): ids of all parts before each part; sums of runs of parts first, then within the runs."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("run", F.floor(F.col("part") / run))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy("run").agg(F.sum("n").alias("n")).select("run", earlier(Window.orderBy("run")).alias("base"))  # one row for 1024 parts
    within = sizes.select("run", "part", earlier(Window.partitionBy("run").orderBy("part")).alias("within"))
    return within.join(runs, "run").select("part", (F.col("within") + F.col("base")).alias("start"))


def read_token_files(files: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Per document: key, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), and the ids."""
    starts = part_starts(files)
    if files.select("part").distinct().count() <= MOST_PARTS:
        starts = F.broadcast(starts)
    placed = files.join(starts, "part").select("image", (F.col("start") + F.col("before")).alias("start"))
    names = [key, "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, start in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                image = Image(memoryview(data.as_buffer()))
                found = image.ids().astype("<u4")
                raw, ends = memoryview(found.tobytes()), np.cumsum(image.counts)
                first = ends - image.counts
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(first.tolist(), ends.tolist(), strict=True)]
                columns = [image.keys, pa.array(first + start), pa.array(image.counts), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(np.concatenate([first, ends[-1:]])), pa.array(found.astype(np.int32))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def store_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = None, by_words: bool = False, **options: int) -> DataFrame:
    """Encode, write (``options``: of ``write_token_files``) and return the table of file images; the ids' own table is deleted."""
    n_ids = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    coded = scratch.table(encode_ids(docs, path, key, text, end, by_words), "ids", compression="zstd")
    files = write_token_files(coded, n_ids, key, **options)
    scratch.drop(coded)
    return files
