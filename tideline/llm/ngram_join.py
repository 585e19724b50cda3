"""Self-join of documents on the Jaccard similarity of their word n-grams, by a token-group matrix.

Tokens are 64-bit hashes of a document's distinct n-grams. The steps:

1. Documents with the same set of tokens form a class; only classes go on.
2. Tokens get one order for the whole table: rare ones by their hash, then the
   frequent ones by their count. Two sets whose similarity reaches the
   threshold then share at least ``need`` tokens of their prefixes of
   ``n - ceil(threshold * n) + need`` tokens, so prefixes are all that has to
   be shuffled. (Any order gives whole results; frequent tokens at its end only
   keep them out of most prefixes.)
3. One sort of all prefix tokens shows which of them several classes share.
   The class that comes first at most of a class's tokens is its hub; classes
   that are linked with their hub are a star, and need no further link inside.
4. Classes that share enough prefix tokens are partitioned into groups: stars,
   and the others by their hub and length. The matrix holds each group's union
   of prefix tokens, as rows (token, group, how many members have it). Joined
   with a class's prefix it bounds the class's overlap with every member of
   the group; tokens that only one star has are left out. Only groups where that
   bound reaches ``need`` qualify; of two groups the smaller one asks.
5. A qualifying group is opened in blocks of bounded size, together with bounded
   runs of the classes that ask: first their prefixes, by a product of incidence
   matrices in slices of columns, which leaves the classes and members that
   share enough for their sizes with one partner; then the whole sets of those.
   Overlap with the union of all the block's tokens bounds again, and the
   product of whole sets decides. Of the links found, a spanning forest leaves
   the task.
6. Connected components of the links give each document's class id.

No key's rows are gathered in one task: copies are reduced to classes before
the shuffle, blocks and runs are bounded, a hot token's rows are sorted into
several partitions, and other frequent keys meet in joins whose sides are
written tables, which adaptive execution can split.

Null texts and texts without words have n_shingles 0 and no link; texts of fewer
words than an n-gram have one token, the whole sequence. A null key is kept but never a
component id. Repeated rows are kept. Classes of different sets share a 64-bit hash with a
probability of n^2 / 2^65 for n different sets; overlaps compare 48 bits of a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import bitfilter, scratch
from tideline.llm.batches import at_end, slices, texts
from tideline.llm.graph import components

#: Frequent tokens: those that make up this share of a slice's tokens, and at most so many.
FREQUENT_SHARE, MOST_FREQUENT = 1 / (1 << 18), 1 << 17
#: Bytes of texts whose tokens are counted together.
COUNTED_BYTES = 4 << 20
#: A block's tokens and classes, in expectation.
BLOCK_TOKENS, BLOCK_CLASSES = 1 << 17, 512
#: need = 1 + floor(n / SPARE): how many tokens of the prefix must be met.
SPARE = 20
#: Columns of a slice of the incidence matrix.
COLUMNS = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words that a worker remembers the hash of.
_REMEMBERED = 1 << 17


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Known()
at_end(_known.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tokens_of(several: list[str], n_words: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's n-grams of words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    if len(_known) > _REMEMBERED:
        _known.clear()
    hashes, sizes = [], []
    for x in several:
        w = x.encode().translate(_LOWER).split()
        hashes.append(np.fromiter(map(_known.__getitem__, w), np.uint64, len(w)))
        sizes.append(len(w))
    h = np.concatenate([*hashes, np.zeros(n_words, np.uint64)])
    t = np.full(len(h) - n_words + 1, n_words, np.uint64)
    for i in range(n_words):
        t = _mix(t + h[i : len(h) - n_words + 1 + i])
    t = (t >> np.uint64(1)).view(np.int64)
    out, at = [], 0
    for n in sizes:
        if n >= n_words:
            out.append(np.unique(t[at : at + n - n_words + 1]))
        else:  # the whole sequence is one token
            one = np.full(min(n, 1), n, np.uint64)
            for i in range(n):
                one = _mix(one + h[at + i : at + i + 1])
            out.append((one >> np.uint64(1)).view(np.int64))
        at += n
    return out


def _fingerprint(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        both = np.array([_mix(tokens.astype(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)
        return int(_mix(both).view(np.int64)[0])


def to_planes(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of sorted tokens, byte by byte: the first bytes of all, then the second and so on, as equal ones compress."""
    return (tokens >> 15).view(np.uint8).reshape(-1, 8)[:, 5::-1].T.tobytes()


def from_planes(planes: pa.BinaryScalar) -> np.ndarray:
    found = np.frombuffer(planes.as_buffer(), np.uint8).reshape(6, -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, 5::-1] = found.T
    return out.view(np.int64).ravel()


def need_of(n: np.ndarray | int) -> np.ndarray | int:
    return 1 + n // SPARE


def rest_of(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of ``n`` tokens are not in the prefix."""
    return n - np.minimum(n, n + percent * -n // 100 + need_of(n))


def frequent_tokens(docs: DataFrame, text: str, n_words: int) -> DataFrame:
    """(token, n): tokens by a lower bound of their count over all documents, of at most MOST_FREQUENT.

    A token with FREQUENT_SHARE of all tokens has it in at least one slice; each
    slice reports those, with their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", COUNTED_BYTES):
            found = np.concatenate([*tokens_of(texts(b, "__text"), n_words), np.empty(0, np.int64)])
            token, n = np.unique(found, return_counts=True)
            kept = (n >= 3) & (n >= len(found) * FREQUENT_SHARE)
            yield pa.RecordBatch.from_arrays([pa.array(token[kept]), pa.array(n[kept].astype(np.int64))], ["token", "n"])

    found = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)


def profiles(docs: DataFrame, key: str, text: str, n_words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: key, n_shingles, set (hash of the token set, null if empty) and prefix (no tokens for a set that the task has met before).

    ``frequent``: tokens in order, and their ranks by count. In a prefix they are their rank with bit 62 set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rank = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[token & (1 << 20) - 1] = True
        met: set[int] = set()
        for b in slices(batches, "__text"):
            n, of, prefixes = [], [], []
            for t in tokens_of(texts(b, "__text"), n_words):
                n.append(len(t))
                of.append(_fingerprint(t) if len(t) else None)
                if not len(t) or of[-1] in met:
                    prefixes.append(None)
                    continue
                met.add(of[-1])
                length = len(t) + percent * -len(t) // 100 + need_of(len(t))
                order = t & (1 << 62) - 1
                if len(at := np.flatnonzero(maybe[t & (1 << 20) - 1])):
                    place = np.minimum(np.searchsorted(token, t[at]), len(token) - 1)
                    hit = token[place] == t[at]
                    order[at[hit]] = rank[place[hit]] | 1 << 62
                prefixes.append(np.partition(order, length)[:length] if length < len(t) else order)
            if len(met) > _REMEMBERED:
                met.clear()
            ends = np.cumsum([0 if p is None else len(p) for p in prefixes])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*(p for p in prefixes if p is not None), np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of, pa.int64()), lists], ["key", "n_shingles", "set", "prefix"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("n_shingles", T.LongType()), T.StructField("set", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def overlaps(queries: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """How many values each query shares with each member, by products of slices of their incidence matrices."""
    union = np.unique(np.concatenate(members))
    row_q, row_m = np.repeat(np.arange(len(queries)), [len(x) for x in queries]), np.repeat(np.arange(len(members)), [len(x) for x in members])
    col_q, col_m = np.concatenate(queries), np.concatenate(members)
    kept = np.isin(col_q, union)
    row_q, col_q, col_m = row_q[kept], np.searchsorted(union, col_q[kept]), np.searchsorted(union, col_m)
    by_q, by_m = np.argsort(col_q, kind="stable"), np.argsort(col_m, kind="stable")
    row_q, col_q, row_m, col_m = row_q[by_q], col_q[by_q], row_m[by_m], col_m[by_m]
    out = np.zeros((len(queries), len(members)), np.float32)  # whole numbers below 2^24 are exact
    for at in range(0, len(union), COLUMNS):
        a, b = np.searchsorted(col_q, [at, at + COLUMNS]), np.searchsorted(col_m, [at, at + COLUMNS])
        if a[0] == a[1]:
            continue
        x, y = np.zeros((len(queries), COLUMNS), np.float32), np.zeros((len(members), COLUMNS), np.float32)
        x[row_q[a[0] : a[1]], col_q[a[0] : a[1]] - at] = 1
        y[row_m[b[0] : b[1]], col_m[b[0] : b[1]] - at] = 1
        out += x @ y.T
    return out.astype(np.int64)


def prefix_partners(queries: list[np.ndarray], n_q: np.ndarray, members: list[np.ndarray], n_m: np.ndarray, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which queries and which members have a partner whose length fits and whose prefix shares what two linked sets must share.

    Up to the end of the prefix that ends first, both prefixes are whole; beyond it the sets share no more than the rest of that one.
    """
    a, b = n_q[:, None], n_m[None, :]
    fits = overlaps(queries, members) >= np.maximum(1, -(-percent * (a + b) // (100 + percent)) - np.maximum(rest_of(a, percent), rest_of(b, percent)))
    fits &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    if same:
        np.fill_diagonal(fits, False)
    return fits.any(1), fits.any(0)


def link_blocks(members: list[np.ndarray], queries: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links of a block's members with each other (queries None), or with queries; as pairs (query, member) that span all links.

    A query opens the block only if its overlap with the union of the members reaches the threshold.
    """
    same = queries is None
    q = members if same else queries
    n_q, n_m = np.array([len(x) for x in q]), np.array([len(x) for x in members])
    opened = np.arange(len(q))
    if not same:
        union = np.unique(np.concatenate(members))
        bound = np.array([np.isin(x, union, assume_unique=True).sum() for x in q])
        opened = np.flatnonzero(100 * bound >= percent * n_q)
    if not len(opened):
        return []
    common = overlaps([q[i] for i in opened], members)
    linked = 100 * common >= percent * (n_q[opened][:, None] + n_m[None, :] - common)
    if same:
        linked = np.triu(linked, 1)
    parent = list(range(len(q) + (0 if same else len(members))))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = find(int(opened[i])), find(j if same else len(q) + j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(opened[i]), j))
    return out


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, set, component_id (least key that links reach, itself included).

    Two documents link when 100 * intersection >= percent * union of their sets of n-grams.
    """
    found = frequent_tokens(docs, text, n_words).toPandas().sort_values(["n", "token"])
    found["rank"] = range(len(found))
    found = found.sort_values("token")
    frequent = (found["token"].to_numpy(np.int64), found["rank"].to_numpy(np.int64))
    profile = scratch.table(profiles(docs, key, text, n_words, percent, frequent), "profiles")
    classes = scratch.table(profile.where("set is not null").groupBy("set").agg(F.min("key").alias("least"), F.max("n_shingles").alias("n")), "classes")
    with scratch.scope() as used:
        labels = components(class_links(docs, profile, classes, key, text, n_words, percent))
        least = labels.join(classes, F.col("node") == F.col("set")).groupBy("label").agg(F.min("least").alias("component"))
        of_class = labels.join(least, "label").select(F.col("node").alias("set"), "component")
        of_class = scratch.table(classes.join(of_class, "set", "left").select("set", F.coalesce("component", "least").alias("component")), "members")
        # written tables on both sides: a hot class's rows can be split
        out = profile.join(of_class, "set", "left")
        out = scratch.table(out.select(F.col("key").alias(key), "n_shingles", F.col("set").alias("set_hash"), F.coalesce("component", "key").alias("component_id")), "components")
        scratch.delete(docs.sparkSession, [p for p in used if p != out._scratch])
        used[:] = [out._scratch]
    scratch.drop(profile, classes)
    return out


def _need(n: Column, percent: int) -> Column:
    """What a set of ``n`` tokens shares at least with the prefix of any set that it is linked with."""
    return 1 + F.floor(F.ceil(n * percent / 100) / SPARE)


def shared_rows(profile: DataFrame, percent: int) -> DataFrame:
    """(set, n, tokens, hub, common): classes with the tokens of their prefix that another class has too, if they are enough.

    One sort by (token, set) brings a token's classes side by side; a hot token
    goes on over several partitions. Tokens at a partition's ends may be kept
    though only one class has them, which costs a row, not a result. ``hub`` is
    the class that comes first at most of the tokens (``common`` of them).
    """
    rows = profile.where("prefix is not null").select(F.explode("prefix").alias("token"), "set", F.col("n_shingles").alias("n"))
    rows = rows.repartitionByRange("token", "set").sortWithinPartitions("token", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None  # the last row, whose follower isn't known yet; the first set of its token

        def judge(rows: np.ndarray, ended: bool) -> tuple[np.ndarray, np.ndarray]:
            """Which rows stay, and the first set of each row's token. The first row was held, or is the partition's first."""
            token, of = rows[0], rows[1]
            new = np.concatenate([[True], token[1:] != token[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            hub = of[start]
            if first is not None:
                hub[start == 0] = first
            alone = new & np.concatenate([new[1:], [not ended]])
            alone[0] &= first is not None and first == of[0]
            return ~alone, hub

        def out(rows: np.ndarray, kept: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (*rows, hub)], ["token", "set", "n", "hub"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy() for i in range(3)])
            if held is not None:
                rows = np.concatenate([held, rows], 1)
            rows = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])]  # a class that several tasks met
            kept, hub = judge(rows, False)
            yield out(rows[:, :-1], kept[:-1], hub[:-1])
            held, first = rows[:, -1:], hub[-1]
        if held is not None:
            yield out(held, *judge(held, True))

    found = rows.mapInArrow(run, "token long, set long, n long, hub long").repartition("set").sortWithinPartitions("set", "token")

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in ("set", "token", "n", "hub")])], 1)
            cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0  # the last set may go on
            yield gather(rows[:, :cut])
            held = rows[:, cut:]
        yield gather(held)

    def gather(rows: np.ndarray) -> pa.RecordBatch:
        of_set, token, n, hub = rows
        new = np.ones(len(of_set), bool)
        new[1:] = of_set[1:] != of_set[:-1]
        of = np.cumsum(new) - 1
        own, n = of_set[new], n[new]
        best, common = own.copy(), np.zeros(len(own), np.int64)
        away = np.flatnonzero(hub != of_set)
        order = away[np.lexsort((hub[away], of[away]))]
        if len(order):
            fresh = np.flatnonzero(np.concatenate([[True], (np.diff(of[order]) != 0) | (np.diff(hub[order]) != 0)]))
            counts = np.diff(np.append(fresh, len(order)))
            by = np.argsort(counts, kind="stable")  # the most frequent hub is written last
            best[of[order[fresh[by]]]], common[of[order[fresh[by]]]] = hub[order[fresh[by]]], counts[by]
        one = new.copy()  # a token that met a set in two partitions counts once
        one[1:] |= token[1:] != token[:-1]
        sizes = np.bincount(of[one], minlength=len(own))
        enough = sizes >= need_of(-(-percent * n // 100))
        kept = one & enough[of] if len(of) else one
        ends = np.concatenate([[0], np.cumsum(sizes[enough])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(token[kept]))
        return pa.RecordBatch.from_arrays([pa.array(own[enough]), pa.array(n[enough]), lists, pa.array(best[enough]), pa.array(common[enough])], ["set", "n", "tokens", "hub", "common"])

    return found.mapInArrow(by_set, "set long, n long, tokens array<long>, hub long, common long")


def hub_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set, hub): the classes that are linked with their hub."""
    of_hub = rows.select(F.col("set").alias("hub"), F.col("n").alias("hub_n"))
    pairs = rows.where("hub <> set").select("set", "hub", "n", "common").join(of_hub, "hub")
    rest = lambda n: n - F.least(n, n - F.ceil(n * percent / 100) + 1 + F.floor(n / SPARE))
    n, m = F.col("n"), F.col("hub_n")
    fits = (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.col("common") >= F.ceil(percent * (n + m) / (100 + percent)) - F.greatest(rest(n), rest(m)))
    pairs = scratch.table(pairs.where(fits).select("set", "hub"), "pairs")
    both = pairs.join(sets, "set").join(sets.select(F.col("set").alias("hub"), F.col("tokens").alias("hub_tokens")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tokens"):
            linked = []
            for x, y in zip(b.column("tokens"), b.column("hub_tokens"), strict=True):
                u, v = from_planes(x), from_planes(y)
                common = np.intersect1d(u, v, assume_unique=True).size
                linked.append(100 * common >= percent * (len(u) + len(v) - common))
            yield b.select(["set", "hub"]).filter(pa.array(linked, pa.bool_()))

    # a class that two tasks met has two rows of its set
    found = scratch.table(both.select("set", "hub", "tokens", "hub_tokens").mapInArrow(run, "set long, hub long").distinct(), "stars")
    scratch.drop(pairs)
    return found


def class_links(docs: DataFrame, profile: DataFrame, classes: DataFrame, key: str, text: str, n_words: int, percent: int) -> DataFrame:
    """(a, b): links between classes that span every component."""
    rows = scratch.table(shared_rows(profile, percent), "rows")
    sets = scratch.table(whole_sets(docs, rows.select("set").join(classes, "set").select(F.col("least").alias("key")), key, text, n_words), "sets")
    stars = hub_links(rows, sets, percent)
    # a star's label is its hub, or that one's hub; classes with one label are linked already
    up = stars.select(F.col("set").alias("hub"), F.col("hub").alias("above"))
    labels = stars.join(up, "hub", "left").select("set", F.coalesce("above", "hub").alias("label"))
    centres = labels.select("label").distinct().join(labels.select(F.col("set").alias("label")), "label", "left_anti")
    labels = scratch.table(labels.union(centres.select(F.col("label").alias("set"), "label")), "labels")
    # groups: a star, or the classes outside of stars that have one hub and about the same length
    placed = rows.join(labels, "set", "left")
    group = F.when(F.col("label").isNull(), F.xxhash64("hub", F.floor(F.log(F.col("n")) / np.log(1.25)))).otherwise(F.xxhash64("label"))
    placed = placed.select("set", "n", "tokens", group.alias("group"), F.coalesce("label", "set").alias("label"))
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_CLASSES))
    groups = placed.groupBy("group").agg(F.count("*").alias("size"), parts.alias("parts"))
    placed = scratch.table(placed.join(groups, "group"), "placed")
    scratch.drop(rows, labels)
    # the matrix, and the bound of each class's overlap with each group; what only shares tokens within its star is left out
    cells = placed.select("set", "n", "label", "group", "size", F.explode("tokens").alias("token"))
    matrix = cells.groupBy("token", F.col("group").alias("other")).agg(F.count("*").alias("members"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("size").alias("other_size"), F.min("label").alias("low"), F.max("label").alias("high"))
    matrix = scratch.table(matrix, "matrix")
    live = matrix.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("token")
    live = matrix.join(live, "token")
    fits = (F.col("n") * 100 >= F.col("least_n") * percent) & (F.col("most_n") * 100 >= F.col("n") * percent)
    foreign = (F.col("low") < F.col("high")) | (F.col("low") != F.col("label"))
    above = F.struct("other_size", "other") > F.struct(F.col("size").alias("other_size"), F.col("group").alias("other"))  # the smaller group asks
    own = cells.join(live, "token").where(fits & foreign & (above | (F.col("group") == F.col("other")) & (F.col("members") > 1)))
    bound = own.groupBy("set", "group", "other").agg(F.count("*").alias("overlap"), F.max("n").alias("n"))
    qualified = scratch.table(bound.where(F.col("overlap") >= _need(F.col("n"), percent)).select("set", "n", "group", "other"), "qualified")
    scratch.drop(matrix)
    return stars.toDF("a", "b").union(opened_links(placed, qualified, sets, percent))


def opened_links(placed: DataFrame, qualified: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of classes with the groups that they qualify for.

    A job is a block of a group and a run of the classes that ask it; or, within
    a group, two blocks of the classes that ask their own group.
    """
    runs = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_CLASSES))
    part = lambda n: F.pmod(F.xxhash64("set"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    job = lambda kind: F.xxhash64(F.lit(kind), "group", "block", "run").alias("job")
    cells = ("set", "n", "tokens")
    outer = qualified.where("group <> other").select("set", "n", F.col("other").alias("group"))
    asked = scratch.table(outer.groupBy("group").agg(runs.alias("runs")), "asked")
    sizes = placed.select("group", "parts").distinct()
    asking = outer.join(asked, "group").join(sizes, "group").select("set", "group", part(F.col("runs")).alias("run"), F.explode(upto(F.col("parts"))).alias("block"))
    members = placed.join(asked, "group").select("set", "group", part(F.col("parts")).alias("block"), F.explode(upto(F.col("runs"))).alias("run"))
    inner = qualified.where("group = other").select("set", "n", "group")
    inner = inner.join(inner.groupBy("group").agg(runs.alias("runs")), "group").withColumn("mine", part(F.col("runs")))
    above = inner.select("set", "group", F.col("mine").alias("run"), F.explode(upto(F.col("runs"))).alias("block")).where("block > run")
    below = inner.select("set", "group", F.col("mine").alias("block"), F.explode(upto(F.col("runs"))).alias("run")).where("run <= block")
    jobs = (
        asking.select(job("outer"), "set", F.lit(False).alias("member"), F.lit(False).alias("same"))
        .union(members.select(job("outer"), "set", F.lit(True), F.lit(False)))
        .union(above.select(job("inner"), "set", F.lit(False), F.lit(False)))
        .union(below.select(job("inner"), "set", F.lit(True), F.col("run") == F.col("block")))
    )
    jobs = jobs.join(placed.select(*cells), "set")

    def narrow(rows: pa.Table) -> pa.Table:
        names, same = ["job", "set", "member", "same"], rows.column("same")[0].as_py()
        member, n = rows.column("member").to_numpy(), rows.column("n").to_numpy()
        m, q = np.flatnonzero(member), np.flatnonzero(member if same else ~member)
        if not len(m) or not len(q):
            return rows.slice(0, 0).select(names)
        tokens = [np.array(x, np.int64) for x in rows.column("tokens").to_pylist()]
        of_q, of_m = prefix_partners([tokens[i] for i in q], n[q], [tokens[i] for i in m], n[m], percent, same)
        kept = m[of_m] if same else np.concatenate([q[of_q], m[of_m]])
        return rows.take(np.sort(kept)).select(names)

    jobs = jobs.groupBy("job").applyInArrow(narrow, "job long, set long, member boolean, same boolean")
    jobs = scratch.table(jobs, "jobs")
    scratch.drop(placed, qualified, asked)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.unique(rows.column("set").to_numpy(), return_index=True)[1])  # a class that two tasks met
        member, ids, same = rows.column("member").to_numpy(), rows.column("set").to_numpy(), rows.column("same")[0].as_py()
        tokens = [from_planes(x) for x in rows.column("tokens")]
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        found = link_blocks([tokens[i] for i in m], None if same else [tokens[i] for i in q], percent) if len(m) and (same or len(q)) else []
        first = m if same else q
        return pa.table({"a": pa.array([ids[first[i]] for i, _ in found], pa.int64()), "b": pa.array([ids[m[j]] for _, j in found], pa.int64())})

    return jobs.join(sets, "set").groupBy("job").applyInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, n_words: int) -> DataFrame:
    """(set, tokens): the tokens (``to_planes``), at least of the documents whose keys are in ``wanted``.

    Keys are looked up in a bit filter of fixed size, so texts are not shuffled;
    a key that it lets through by mistake gives a row that no join will find.
    """
    shared = bitfilter.build(wanted.select(bitfilter.bit_of(F.col("key")).alias("bit")))
    source = docs.select(bitfilter.bit_of(F.col(key)).alias("bit"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = shared.value, set()
        for b in slices(batches, "__text"):
            b = b.filter(pa.array(bitfilter.holds(bits, b.column("bit").to_numpy())))
            ids, tokens = [], []
            for t in tokens_of(texts(b, "__text"), n_words):
                if len(t) and (i := _fingerprint(t)) not in met:
                    met.add(i)
                    ids.append(i)
                    tokens.append(to_planes(t))
            if len(met) > _REMEMBERED:
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], ["set", "tokens"])

    return source.mapInArrow(run, "set long, tokens binary")
