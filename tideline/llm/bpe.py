"""Byte-level BPE encoding and decoding.

A text is split by the public pattern; each distinct piece is encoded once per
worker. Pieces that are no token themselves are put into padded matrices, one
for each power-of-two length. In each round every row merges its leftmost pair
of the least rank; ranks of pairs come from an open-addressing hash table, and
a row is compacted by dropping the cells that its merges have freed. Rows
without a pair left leave the matrix. As that takes as many rounds as a piece
has merges, the matrix of pieces over ``LONG`` bytes takes the rounds that
merge one pair after the other of one rank together, from left to right; if
that made a pair of lower rank, which then would be next, only the leftmost is merged.

Null texts count as empty and have no ids. Repeated rows are kept as they are.
A text's pieces are looked at ``PIECES`` at a time, so that memory stays with the text's own size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import at_end, slices, texts

#: Bytes of a piece beyond which rounds of one rank are taken together.
LONG = 512
#: Pieces of a text that are looked up together.
PIECES = 1 << 18
#: Distinct pieces that a worker remembers; a full memory is emptied.
REMEMBERED = 200_000
#: Cells of one matrix.
CELLS = 1 << 21
NO_PAIR = np.iinfo(np.int32).max


class PairTable:
    """(left id, right id) -> id of the joined bytes, by linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(slot), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NO_PAIR, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[open_])
        while len(open_):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(self.ranks[b[:k]] << 32 | self.ranks[b[k:]]): i for b, i in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks}
        self.pairs = PairTable(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        width = 2
        while True:
            of_width = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            if width > LONG:
                for i in of_width.tolist():
                    out[i] = self._merge_long(pieces[i])
                of_width = of_width[:0]
            for at in range(0, len(of_width), max(1, CELLS // width)):
                self._merge_rows([int(i) for i in of_width[at : at + max(1, CELLS // width)]], pieces, width, out)
            if not len(lengths) or width >= lengths.max():
                return out
            width *= 2

    def _merge_rows(self, rows: list[int], pieces: list[bytes], width: int, out: list[np.ndarray]) -> None:
        sizes = np.array([len(pieces[i]) for i in rows])
        cells = np.full((len(rows), width), -1, np.int32)
        cells[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        which = np.array(rows)
        rank = self.pairs.get(cells[:, :-1], cells[:, 1:])
        while len(which):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(which), np.int64)
            least = rank[np.arange(len(which)), at] if rank.shape[1] else np.full(len(which), NO_PAIR)
            done = least == NO_PAIR
            for r in np.flatnonzero(done):
                out[which[r]] = cells[r][cells[r] >= 0]
            cells, rank, which, at, least = cells[~done], rank[~done], which[~done], at[~done], least[~done]
            if not len(which):
                return
            n, every = len(which), np.arange(len(which))
            cells[every, at] = least
            keep = np.ones(cells.shape, bool)
            keep[every, at + 1] = False
            cells = cells[keep].reshape(n, -1)
            keep = np.ones(rank.shape, bool)
            keep[every, at] = False
            rank = rank[keep].reshape(n, -1)
            for side in (at - 1, at):  # only the pairs beside the merged cell have a new rank
                ok = (side >= 0) & (side < rank.shape[1])
                rank[every[ok], side[ok]] = self.pairs.get(cells[every[ok], side[ok]], cells[every[ok], side[ok] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of a piece: a matrix of one row, the rounds of one rank together."""
        cells = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.get(cells[:-1], cells[1:])
        while len(rank) and (least := rank.min()) != NO_PAIR:
            at = np.flatnonzero(rank == least)
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]  # pairs that overlap: every other one, from the left
            merged, ranks = self._round(cells, rank, at, least)
            if len(ranks) and ranks.min() < least:
                merged, ranks = self._round(cells, rank, at[:1], least)
            cells, rank = merged, ranks
        return cells

    def _round(self, cells: np.ndarray, rank: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, ranks) once the pairs at ``at`` have become ``token``."""
        cells = cells.copy()
        cells[at] = token
        cells, rank = np.delete(cells, at + 1), np.delete(rank, at)
        here = at - np.arange(len(at))
        beside = np.unique(np.concatenate([here - 1, here]))
        beside = beside[(beside >= 0) & (beside < len(rank))]
        rank[beside] = self.pairs.get(cells[beside], cells[beside + 1])
        return cells, rank

    def _learn(self, new: list[str]) -> None:
        coded = [p.encode() for p in new]
        got: list[np.ndarray] = [np.empty(0, np.int32)] * len(new)
        short, where = [], []
        for i, b in enumerate(coded):
            if (whole := self.ranks.get(b)) is not None:
                got[i] = np.array([whole], np.int32)
            else:
                short.append(b)
                where.append(i)
        for i, ids in zip(where, self.matrix(short), strict=True):
            got[i] = ids
        lengths = np.array([len(x) for x in got], np.int64)
        begin = len(self.flat) + np.cumsum(lengths) - lengths
        self.known.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.flat, self.start, self.length = np.concatenate([self.flat, *got]), np.concatenate([self.start, begin]), np.concatenate([self.length, lengths])

    def encode(self, several: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in several]
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, x in enumerate(several):
            found = self.pattern.finditer(x) if len(x) > PIECES else iter(())
            pieces = self.pattern.findall(x) if len(x) <= PIECES else [m[0] for m in islice(found, PIECES)]
            while pieces:
                held.append((i, pieces))
                n += len(pieces)
                if n >= PIECES:
                    self._look_up(held, out)
                    held, n = [], 0
                pieces = [m[0] for m in islice(found, PIECES)]
        self._look_up(held, out)
        return [x[0] if len(x) == 1 else np.concatenate([np.empty(0, np.int32), *x]) for x in out]

    def _look_up(self, held: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        """Add the ids of (index of a text, pieces)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = set().union(*(p for _, p in held)) - self.known.keys()
        if new:
            self._learn(sorted(new))
        for i, p in held:
            index = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
            lengths = self.length[index]
            ends = np.cumsum(lengths)
            out[i].append(self.flat[np.repeat(self.start[index] - (ends - lengths), lengths) + np.arange(int(ends[-1]))])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    c = Codec(path, pattern)
    at_end(c._forget)
    return c


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", check: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``out``: array of the text's ids. ``check``: a further column, whether decoding them gives the text back."""
    names = [f.name for f in df.select(*keep).schema.fields]
    more = [f"`{out}` array<int>"] + ([f"`{check}` boolean"] if check else [])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields] + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "__text"):
            several = texts(b, "__text")
            ids = c.encode(several)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            more = [lists] + ([pa.array([c.decode(x.tolist()) == t.encode() for x, t in zip(ids, several, strict=True)], pa.bool_())] if check else [])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *more], [*names, out, *([check] if check else [])])

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """The columns ``keep`` and ``out``: the bytes that the ids stand for; null ids count as none."""
    fields = df.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            decoded = pa.array([c.decode(x or []) for x in b.column("__ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(fields))), decoded], [*(f.name for f in fields), out])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes.

    Encoding and decoding share one pass, so the ids never cross the Python boundary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "__text"):
            n, coded, decoded = [], [], []
            for ids in c.encode(texts(b, "__text")):
                ids = ids.tolist()
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
