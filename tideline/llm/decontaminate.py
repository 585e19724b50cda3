"""Benchmark decontamination by suffix arrays over the training texts.

The training texts are cut into shards, slices of a task's rows. Within a
shard a suffix can only match a benchmark item as long as its words are words
of the benchmark, so the shard's suffix array holds the suffixes of those runs
of benchmark words that are at least as long as the shortest window; other
suffixes can't hold a match. It is built by prefix doubling up to the length
of the longest item. Every suffix of every item is then searched in it, to the
end of its longest match: all
searches narrow their intervals together, one word deeper in each round, by
vectorised binary search; searches that are in one interval with one next word
are one. The interval at the depth of the item's window stands for all
occurrences of the window, and where an interval gets narrower, the places that
leave it have their longest match with that suffix. Intervals are never
multiplied out: hits are marked over the array, documents meet
intervals once, and each place keeps its longest match only.

The items are dealt into blocks of bounded bytes, one broadcast each, and each
shard is searched for one block after the other; a task lets go of a block
before it loads the next. Documents are never shuffled.

Null and wordless texts have no words and no hits. Null and wordless items have
no window; items without an id count under no id but still mark hits. Repeated
items count once, repeated documents each. An item of fewer than ``window``
words is one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.batches import slices, texts, with_row

#: Words of a window.
WINDOW = 10
#: Most bytes of items in a broadcast.
BLOCK_BYTES = 8 << 20
#: Bytes of texts in a shard.
SHARD_BYTES = 4 << 20

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.encode().translate(_WORD_BYTES).split()


class Items:
    """A block of items: their words as numbers, in one array."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        coded = []
        for name, text in rows:
            if words := words_of(text):
                self.names.append(name)
                coded.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
        self.lengths = np.array([len(x) for x in coded], np.int64)
        self.words = np.concatenate([*coded, np.empty(0, np.int32)])
        self.item = np.repeat(np.arange(len(coded)), self.lengths)
        ends = np.cumsum(self.lengths)
        self.place = np.arange(len(self.words)) - (ends - self.lengths)[self.item]
        self.left = self.lengths[self.item] - self.place  # words from here to the item's end
        self.window = np.minimum(self.lengths, window)

    def least(self) -> int:
        return int(self.window.min()) if len(self.window) else 0


def suffix_array(words: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of ``words`` in order of their first ``depth`` words. ``end``: the next 0, which ends a suffix."""
    rank, k = words.astype(np.int64), 1
    while k < depth:
        key = rank * (int(rank.max(initial=0)) + 1) + rank[np.minimum(np.arange(len(words)) + k, end)]
        key[words == 0] = -1  # stays the least, so its rank stays 0
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        k *= 2
    order = np.argsort(rank, kind="stable")
    return order[words[order] > 0]


def _bisect(words: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray, past: bool) -> np.ndarray:
    """The first place in [low, high) whose suffix has at ``depth`` a word not below (past: above) the wanted one."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        found = words[array[middle] + depth]
        below = found <= wanted[open_] if past else found < wanted[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
    return low


def search(words: np.ndarray, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(windows, longest): columns of (index of an item's word, first and last place in the array, depth).

    ``windows``: the intervals of the suffixes that begin with a whole window, at its length.
    ``longest``: intervals of a window or more just before they get narrower, or where the item ends.
    """
    start_of = np.flatnonzero(items.left >= items.window[items.item])  # suffixes in which a whole window fits
    need, left = items.window[items.item[start_of]], items.left[start_of]
    low, high = np.zeros(len(start_of), np.int64), np.full(len(start_of), len(array), np.int64)
    live, depth = np.arange(len(start_of)), 0
    windows, longest = [np.empty((4, 0), np.int64)], [np.empty((4, 0), np.int64)]

    def keep(into: list[np.ndarray], which: np.ndarray) -> None:
        if into is longest:  # of one depth, intervals with one beginning are one
            which = which[np.unique(low[which], return_index=True)[1]]
        if len(which):
            into.append(np.stack([start_of[which], low[which], high[which], np.full(len(which), depth)]))

    while True:
        keep(windows, live[need[live] == depth])
        more = left[live] > depth
        keep(longest, live[~more])
        live = live[more]
        if not len(live):
            return np.concatenate(windows, 1), np.concatenate(longest, 1)
        wanted = items.words[start_of[live] + depth]
        _, one, of = np.unique(low[live] * (len(items.vocabulary) + 1) + wanted, return_index=True, return_inverse=True)
        first = _bisect(words, array, low[live[one]], high[live[one]], depth, wanted[one], False)
        last = _bisect(words, array, first, high[live[one]], depth, wanted[one], True)
        first, last = first[of], last[of]
        keep(longest, live[(last - first < high[live] - low[live]) & (depth >= need[live])])
        low[live], high[live] = first, last
        live = live[last > first]
        depth += 1


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which interval, place in the array) of all places of intervals."""
    counts = high - low
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(low)), counts)
    return of, np.arange(len(of)) - np.repeat(ends - counts - low, counts)


def item_sets(doc: np.ndarray, array: np.ndarray, windows: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) pairs with a window in common. ``doc``: the document of each place of the array.

    Items that share an interval are one set, and a document meets a set once, so that
    what many items have in common isn't multiplied by its occurrences.
    """
    order = np.lexsort((items.item[windows[0]], windows[2], windows[1], windows[3]))
    word, low, high, depth = windows[:, order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(depth) != 0)
    first = np.flatnonzero(fresh)
    sets: dict[bytes, int] = {}
    members = [np.unique(items.item[w]) for w in np.split(word, first[1:])]
    of_interval = np.array([sets.setdefault(m.tobytes(), len(sets)) for m in members], np.int64)
    of, place = _spread(low[first], high[first])
    docs, n = int(doc.max()) + 1, len(items.lengths)
    which, met = np.divmod(np.unique(of_interval[of] * docs + doc[place]), docs)
    several = [np.frombuffer(m, np.int64) for m in sets]
    sizes = np.array([len(m) for m in several], np.int64)
    return np.divmod(np.unique(np.repeat(met, sizes[which]) * n + np.concatenate([several[s] for s in which.tolist()])), n)


def scan_slice(several: list[str], blocks: Iterator[Items]) -> list[tuple[int, int, list[str], bool, list[dict]]]:
    """Per text: n_words, n_hit, the items with occurring windows in order, whether any occurs, and the longest matches."""
    words = [words_of(x) for x in several]
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    hit = np.zeros(int(begin[-1]) + 1, np.int32)
    names: list[set[str]] = [set() for _ in several]
    matches: list[list[dict]] = [[] for _ in several]
    for items in blocks:
        least = items.least()
        if not least:
            continue
        ids = np.zeros(int(begin[-1]), np.int32)
        for w, b in zip(words, begin, strict=False):
            ids[b : b + len(w)] = list(map(items.vocabulary.get, w, repeat(0)))
        zeros = np.flatnonzero(ids == 0)
        run = np.diff(zeros, prepend=-1) - 1
        at = np.flatnonzero(np.repeat(run, run + 1) >= least)
        if not len(at):
            continue
        known = ids[at]
        zeros = np.flatnonzero(known == 0)
        array = suffix_array(known, zeros[np.searchsorted(zeros, np.arange(len(known)))], int(items.lengths.max()))
        windows, longest = search(known, array, items)
        if not windows.shape[1]:
            continue
        for length in np.unique(windows[3]).tolist():  # a window's length is that of a short item, or WINDOW
            low, high = windows[1:3, windows[3] == length]
            edges = np.zeros(len(array) + 1, np.int64)
            np.add.at(edges, low, 1)
            np.add.at(edges, high, -1)
            place = at[array[np.cumsum(edges)[:-1] > 0]]
            hit[place] += 1
            hit[place + length] -= 1
        doc = np.searchsorted(begin, at[array], "right") - 1
        for d, i in zip(*(x.tolist() for x in item_sets(doc, array, windows, items)), strict=True):
            if items.names[i] is not None:
                names[d].add(items.names[i])
        # each place's longest match; a place that only continues the one before it has none of its own
        _, one = np.unique(longest[[3, 1, 2]], axis=1, return_index=True)
        length, word = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
        for w, low, high, n in longest[:, one].T.tolist():  # the deepest last
            length[low:high], word[low:high] = n, w
        by_place = np.zeros(len(ids) + 1, np.int64)
        found = np.flatnonzero(length)
        by_place[at[array[found]] + 1] = length[found]
        own = found[by_place[at[array[found]]] <= length[found]]
        own = own[np.argsort(at[array[own]])]
        place = at[array[own]]
        for d, p, w, n in zip(doc[own].tolist(), (place - begin[doc[own]]).tolist(), word[own].tolist(), length[own].tolist(), strict=True):
            i = int(items.item[w])
            matches[d].append({"item_id": items.names[i], "item_word": int(items.place[w]), "word": p, "words": n})
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
    hits = covered[begin[1:]] - covered[begin[:-1]]
    matches = [_longest(m) for m in matches]
    return [(int(n), int(h), sorted(x), bool(h), m) for n, h, x, m in zip(sizes, hits, names, matches, strict=True)]


def _longest(matches: list[dict]) -> list[dict]:
    """Those of several blocks that don't lie within another one."""
    out, end = [], 0
    for m in sorted(matches, key=lambda m: (m["word"], -m["words"])):
        if m["word"] + m["words"] > end:
            out.append(m)
            end = m["word"] + m["words"]
    return out


def _blocks(items: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int) -> list:
    """Broadcasts of Items, each of about ``block_bytes`` of texts."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return [spark.sparkContext.broadcast([(r["id"], r["text"]) for r in dealt.where(F.col("block") == i).select("id", "text").toLocalIterator()]) for i in range(n)]


_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("item_word", "word", "words"))]))
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("word", pa.int32()), ("words", pa.int32())]))


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``row`` (struct of all its columns), n_words, n_hit, items, contaminated, matches.

    ``items``: ids as strings, in order; ``matches``: the longest verbatim match at each place where a window or more
    begins that doesn't just continue the match before it, with one item that has it and the first word's place in both texts.
    """
    broadcasts = _blocks(items, item_id, item_text, window, block_bytes)
    source, at = with_row(docs, text)
    schema = T.StructType([source.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()), T.StructField("matches", _MATCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Items] = []

        def blocks() -> Iterator[Items]:
            if len(broadcasts) == 1:  # the usual case: made once
                if not held:
                    held.append(Items(broadcasts[0].value, window))
                yield held[0]
            else:
                for b in broadcasts:
                    yield Items(b.value, window)
                    vars(b).pop("_value", None)  # a worker would keep every block that it has loaded

        for b in slices(batches, at, SHARD_BYTES):
            found = scan_slice(texts(b, at), blocks())
            n, h, names, bad, matches = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(bad, pa.bool_()), pa.array(matches, _MATCH_ARROW)],
                ["row", "n_words", "n_hit", "items", "contaminated", "matches"],
            )

    return source.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents, all columns, in which no window occurs."""
    return find_contamination(docs, items, **options).where(~F.col("contaminated")).select("row.*")
