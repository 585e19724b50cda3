"""Alignment of two tokenizers over one text, and how often their tokens are linked.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces)
reads the text and adds the space itself, so both spell the same bytes. The
cumulative ends of their tokens' bytes that both have (``intersect1d``) cut the
text into groups; ``searchsorted`` gives each token its group; and every A token
is linked with every B token of its group, by repeating. As no token of either
tokenizer goes on from a word into white space, the ends of words are cuts, and
a worker aligns each distinct word with the white space before it once, all new
ones of a slice in one go. Of a group, distinct ids are multiplied with their
counts, not their occurrences.

An id pair's count is the number of documents that hold it. Tasks count pairs
of many documents together; those counts are shuffled by pair and salt and then
by pair. To tell each document its pairs' counts, the pairs of the greatest
counts, ``FREQUENT`` at most, are broadcast, and only a document's other pairs,
of which none is in many documents, are joined by a shuffle.

Texts that are null or empty, or whose tokens don't spell the space and the
text (as B reads U+2581 as a space), have no tokens and only zeros. Special
tokens' strings are plain text. Repeated rows count each; ids may be null or
repeat. An empty table gives no rows. Of a text of any length only its distinct
words and pairs are held. Columns besides key and text aren't read, so that
their names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tideline.llm import scratch
from tideline.llm.batches import slices, texts
from tideline.llm.token_files import Known

#: Distinct words that a worker remembers; a full memory is emptied. Words that A encodes together.
REMEMBERED, TOGETHER = 400_000, 512
#: Most pairs in the broadcast (16 bytes each).
FREQUENT = 1 << 20
#: Pairs whose counts a task holds before it sends them; parts into which a pair's partial counts are dealt.
HELD, SALTS = 1 << 22, 16
#: Characters that the pattern of tokenizer A takes as white space.
_SPACE = "\t-\r \x85\xa0  -     　"
#: White space and what follows it; where a carriage return follows, more of the same, as B has pieces that end with one.
_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:\r[{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")
_LAST = re.compile(f"[{_SPACE}]\\Z")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary of a byte-level tokenizer: printable ones for themselves, others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the words that have been aligned."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        letters = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        # a piece that goes on from another character into white space would cross the end of a word
        self.crossing = [p for p in pieces if re.search(f"[^{_SPACE}▁](?!\r)[{_SPACE}▁]|^▁(?!\r)[{_SPACE}]", p)]
        self.pairs_wide = len(self.bytes_b)
        self._forget()

    def _forget(self) -> None:
        self.known = Known()
        self.numbers = np.empty((5, 0), np.int64)  # bytes fit, A's tokens, B's tokens, groups, links
        self.text: list[bytes] = []
        self.pair_start, self.pair_count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def ids_a(self, words: list[str]) -> list[list[int]]:
        """A's ids of words that begin with white space; those that end with it are encoded by themselves, as it would join what follows."""
        out: list[list[int]] = [[]] * len(words)
        alone = [i for i, w in enumerate(words) if _LAST.search(w)]
        rest = [i for i, w in enumerate(words) if not _LAST.search(w)]
        runs = [[i] for i in alone] + [rest[at : at + TOGETHER] for at in range(0, len(rest), TOGETHER)]
        for run, found in zip(runs, self.a.encode_batch_fast(["".join(words[i] for i in run) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int64)
            ends = np.cumsum([len(words[i].encode()) for i in run])
            cut = np.searchsorted(np.cumsum(self.size_a[ids]), ends, "left") + 1
            for i, part in zip(run, np.split(ids, cut[:-1]), strict=True):
                out[i] = part.tolist()
        return out

    def ids_b(self, words: list[str]) -> list[list[int]]:
        """B's ids of words that begin with white space, of which a space is what B adds itself."""
        bare = [w[1:] if w[0] == " " else w for w in words]
        found = self.b.encode(bare, num_threads=1)
        return [[self.space] if w == " " else ids if w[0] == " " else ids[1:] for w, ids in zip(words, found, strict=True)]

    def _learn(self) -> None:
        words, self.known.new = self.known.new, []
        a, b = self.ids_a(words), self.ids_b(words)
        coded = [w.encode() for w in words]
        fits = [b"".join(map(self.bytes_a.__getitem__, x)) == c == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, c in zip(a, b, coded, strict=True)]
        none: list[int] = []
        a, b = ([x if ok else none for x, ok in zip(t, fits, strict=True)] for t in (a, b))
        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        flat_a, flat_b = (np.array([i for x in t for i in x], np.int64) for t in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        common = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        word = np.repeat(np.arange(len(words)), n_a)
        groups = len(common)
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        word_of = np.zeros(groups, np.int64)
        word_of[group_a] = word
        n_groups = np.bincount(word_of, minlength=len(words)) if groups else np.zeros(len(words), np.int64)
        n_links = np.bincount(word_of, in_a * in_b, len(words)).astype(np.int64) if groups else np.zeros(len(words), np.int64)
        self._write(len(words), word_of, group_a, group_b, flat_a, flat_b)
        # distinct ids of each group, with their counts, multiplied
        (of_a, id_a, c_a), (of_b, id_b, c_b) = self._distinct(group_a, flat_a), self._distinct(group_b, flat_b)
        d_b = np.bincount(of_b, minlength=groups)
        first_b = np.cumsum(d_b) - d_b
        times = d_b[of_a]
        left = np.repeat(np.arange(len(of_a)), times)
        right = np.repeat(first_b[of_a] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        key = id_a[left] * self.pairs_wide + id_b[right]
        linked = c_a[left] * c_b[right]
        at = word_of[of_a[left]]
        order = np.lexsort((key, at))
        key, linked, at = key[order], linked[order], at[order]
        fresh = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
        count = np.bincount(at[fresh], minlength=len(words))
        self.numbers = np.concatenate([self.numbers, np.stack([np.array(fits, np.int64), n_a, n_b, n_groups, n_links])], 1)
        self.pair_start = np.concatenate([self.pair_start, len(self.pairs) + np.cumsum(count) - count])
        self.pair_count = np.concatenate([self.pair_count, count])
        self.pairs = np.concatenate([self.pairs, key[fresh]])
        self.times = np.concatenate([self.times, np.add.reduceat(linked, fresh) if len(fresh) else linked])

    def _distinct(self, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, counts = np.unique(group << 32 | ids, return_counts=True)
        return keys >> 32, keys & 0xFFFFFFFF, counts

    def _write(self, n: int, word_of: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray) -> None:
        """Each word's groups as text: ``a1,a2|b1;a3|b2,b3``."""
        group = np.concatenate([group_a, group_b])
        order = np.argsort(group * 2 + (np.arange(len(group)) >= len(group_a)), kind="stable")
        which, group = (np.arange(len(group)) >= len(group_a))[order], group[order]
        ids = np.concatenate([flat_a, flat_b])[order]
        after = np.where(np.diff(group, append=-1) != 0, 2, np.where(np.diff(which, append=True), 1, 0))  # ; | ,
        marks = (b",", b"|", b";")
        tokens = [b"%d%s" % (i, marks[m]) for i, m in zip(ids.tolist(), after.tolist(), strict=True)]
        edges = np.searchsorted(word_of[group], np.arange(n + 1)).tolist() if len(group) else [0] * (n + 1)
        self.text.extend(b"".join(tokens[x:y])[:-1] for x, y in zip(edges[:-1], edges[1:], strict=True))

    def align(self, several: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(A's tokens, B's tokens, groups, links of each text), its groups as text, number of its distinct pairs, and all pairs and their links."""
        if len(self.known) > REMEMBERED:
            self._forget()
        words, counts = [], np.zeros(len(several), np.int64)
        for i, x in enumerate(several):
            if x:
                w = _WORD.findall(" " + x)
                counts[i] = len(w)
                words += w
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn()
        edges = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(several)), counts)
        whole = np.bincount(doc, 1 - self.numbers[0][index], len(several)) == 0
        numbers = np.stack([np.bincount(doc, self.numbers[k][index], len(several)).astype(np.int64) * whole for k in range(1, 5)])
        written = [b";".join(map(self.text.__getitem__, index[a:b].tolist())) if ok else b"" for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), whole.tolist(), strict=True)]
        # a text's distinct words first, then their pairs
        cells, times = np.unique(doc[whole[doc]] << 32 | index[whole[doc]], return_counts=True)
        doc, index = cells >> 32, cells & 0xFFFFFFFF
        n = self.pair_count[index]
        at = np.repeat(self.pair_start[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key, linked = np.repeat(doc, n) << 48 | self.pairs[at], np.repeat(times, n) * self.times[at]
        order = np.argsort(key, kind="stable")
        key, linked = key[order], linked[order]
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        linked = np.add.reduceat(linked, fresh) if len(fresh) else linked
        key = key[fresh]
        return numbers, written, np.bincount(key >> 48, minlength=len(several)), key & (1 << 48) - 1, linked


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    found = Aligner(byte_path, piece_path)
    if found.crossing:
        raise ValueError(f"pieces of {piece_path} cross the ends of words: {found.crossing[:5]}")
    return found


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", written: bool = False) -> DataFrame:
    """Per row: row (a number of its own), key, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (its distinct pairs, A's id times B's vocabulary plus B's id, and their links).

    ``written``: also ``groups``, the groups as text.
    """
    names = ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if written else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        for b in slices(batches, "__text"):
            numbers, groups, n, pairs, times = aligner.align(texts(b, "__text"))
            edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            sha = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups])
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (pairs, times)]
            more = [pa.array([g.decode() for g in groups])] if written else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, numbers), sha, *lists, *more], names)

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col(text).cast("string").alias("__text"))
    schema = f"row long, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return source.mapInArrow(run, schema + (", groups string" if written else ""))


def pair_counts(aligned: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, n): in how many rows a pair is linked, by a shuffle of partial counts by pair and salt and one by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged(parts: list[np.ndarray]) -> None:
            nonlocal keys, counts
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            both, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys = both

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            x = b.column(0)
            for at in range(0, len(x), 1024):
                part = x.slice(at, 1024).flatten().to_numpy()
                held.append(part)
                size += len(part)
                if size > HELD:
                    merged(held)
                    held, size = [], 0
                    if len(keys) > HELD:
                        yield from out(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        if held:
            merged(held)
        yield from out(keys, counts)

    def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["pair", "n"])

    partial = aligned.select("pairs").mapInArrow(run, "pair long, n long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return partial.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, counts: DataFrame, n_pieces: int, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (a written table) without its pairs, and n_best, count_sum: links whose count is their A id's highest, and the counts' sum over all links.

    ``counts``: a written table of (pair, n); ``n_pieces``: B's vocabulary.
    """
    sc = aligned.sparkSession.sparkContext
    best = np.zeros(1, np.int64)
    for r in counts.groupBy((F.col("pair") / n_pieces).cast("long").alias("a")).agg(F.max("n").alias("n")).collect():  # a row an id of A
        if r["a"] >= len(best):
            best = np.concatenate([best, np.zeros(r["a"] + 1 - len(best), np.int64)])
        best[r["a"]] = r["n"]
    least = _least_count(counts, frequent)
    often = counts.where(F.col("n") >= least).toArrow()  # at most ``frequent``
    pair, n = (often.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    shared = sc.broadcast((pair[order], n[order], best))
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                lists = b.column("pairs")
                sizes = np.diff(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                key, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy()
                where = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
                hit = pair[where] == key if len(pair) else np.zeros(len(key), bool)
                n = count[where[hit]]
                summed, top = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(summed, doc[hit], n * times[hit])
                np.add.at(top, doc[hit], times[hit] * (n == best[key[hit] // n_pieces]))
                edges = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(sizes)))]).astype(np.int32)
                seldom = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x[~hit])) for x in (key, times)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(top), pa.array(summed), *seldom], [*rest, "n_best", "count_sum", "pairs", "times"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*rest).schema.fields)
    scored = aligned.mapInArrow(run, fields + ", n_best long, count_sum long, pairs array<long>, times array<long>")
    if least <= 1:  # all pairs were broadcast
        return scored.drop("pairs", "times")
    scored = scratch.table(scored, "scored")
    tops = aligned.sparkSession.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, most long")
    rows = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    found = rows.join(counts.where(F.col("n") < least), F.col("pairs") == F.col("pair")).withColumn("a", (F.col("pair") / n_pieces).cast("long")).join(F.broadcast(tops), "a")  # a row an id of A
    more = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    joined = scored.drop("pairs", "times").join(more, "row", "left")
    added = {c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return joined.withColumns(added).drop("more_best", "more_sum")


def _least_count(counts: DataFrame, frequent: int) -> int:
    """The least power of two that at most ``frequent`` pairs reach."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    total, least = 0, 64
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > frequent:
            break
        least = k
    return 1 << min(least, 62)


def link_scores(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = scratch.table(align(docs, byte_path, piece_path, key, text), "aligned", compression="zstd")
    counts = scratch.table(pair_counts(aligned), "pairs", compression="zstd")
    pieces = SentencePieceProcessor(model_file=piece_path).get_piece_size()
    return score(aligned, counts, pieces, frequent).select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
