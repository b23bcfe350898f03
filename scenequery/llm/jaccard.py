"""Near-duplicate classes: an exact join of documents on the Jaccard similarity of their word 5-grams.

1. Equal shingle sets become one class (64-bit hashes stand for shingles and sets).
2. Two sets of which 75 % is shared have, among the first ``prefix_length`` of their shingles in the order of their hashes,
   at least ``least_shared`` in common. Shingles of the prefixes meet by hash over all documents; a class with fewer prefix
   shingles that any other class has cannot link and is done. This leaves out documents that merely hold a common passage.
3. Signature trees link the rest, in blocks: a node holds the OR of its sets' bitmaps and the range of their sizes, and
   pairs of nodes are walked down together, unless their sizes or the bits they share rule out 75 %, or all they hold is
   one class already. Blocks of classes with the same minimal hash, salted where large, come first and join most of what
   belongs together.
4. Then every two classes that still share enough prefix shingles are compared. Where a shingle is rare, its pairs of classes
   are listed: the members of the larger class come in salted blocks, those of the smaller one in each. Where many classes
   have it, no pairs are listed: all members meet in blocks of two salts each. Nothing is left out, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

NGRAM = 5
BLOCK = 4096
LISTED = 48
FANOUT = 8
AT_ONCE = 1024
MOST_BITS = 15
FLUSH = 500_000
SMALL_ENOUGH_TO_SEND = 500_000  # ids of 8 bytes: 4 MB

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_P, _Q = 0x100000001B3, 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    if len(kept.get(base, ())) < n:
        with np.errstate(over="ignore"):
            kept[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base, np.uint64), dtype=np.uint64)])
    return kept[base][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z in lower case, in order."""
    raw = np.frombuffer(text.encode(), np.uint8) if text else np.zeros(0, np.uint8)
    lower = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
    inside = (lower != 32) & ((lower < 9) | (lower > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # a word's bytes count as digits from its start, so it hashes the same wherever it stands
    letters = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(lower.astype(np.uint64) + _MIX[0]) * _powers(_P, len(lower)))])
    inverse = _powers(pow(_P, -1, 1 << 64), len(lower) + 1)
    return _mixed((letters[ends] - letters[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; with fewer words, of the whole sequence."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(n, len(words))
    found = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        found = found * np.uint64(_Q) + words[k : len(words) - width + 1 + k]
    return np.unique(_mixed(found + np.uint64(width)))


def _needed(n):
    return -(-3 * n // 4)


def _extra(n):
    return np.maximum(1, n // 6)


def prefix_length(n):
    """How many of a set's n shingles are looked at: a linked pair has min(_extra) of them in common."""
    return np.minimum(n, n - _needed(n) + _extra(n))


def least_shared(n):
    """Prefix shingles that a set of n shares with any set it links with; the other has at least 3/4 of n."""
    return _extra(_needed(n))


def _key(found: np.ndarray) -> int:
    return int(np.int64(_mixed(np.array([found.sum() + np.uint64(len(found))], np.uint64)).view(np.int64)[0]))


# ---- signature trees -----------------------------------------------------------------------------------------------------


def link_block(sets: list[np.ndarray], classes: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect what belongs together among ``sets``; pairs already in one class are not compared."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
    sets = [sets[i] for i in order]
    _, label = np.unique(classes[order], return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    bits = min(MOST_BITS, max(10, int(8 * sizes.max() - 1).bit_length()))
    maps = np.zeros((len(sets), 1 << (bits - 6)), np.uint64)
    for i, s in enumerate(sets):
        flags = np.zeros(1 << bits, bool)
        flags[s >> np.uint64(64 - bits)] = True
        maps[i] = np.packbits(flags).view(np.uint64)
    lost = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
    levels = [(maps, sizes, sizes, lost)]
    while len(levels[-1][0]) > 1:
        cut = np.arange(0, len(levels[-1][0]), FANOUT)
        m, low, high, gone = levels[-1]
        levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(gone, cut)))
    links: list[tuple[int, int]] = []
    steps = np.arange(FANOUT)

    def walk(level: int, left: np.ndarray, right: np.ndarray) -> None:
        m, low, high, gone = levels[level]
        if level:
            cut = np.arange(0, len(sets), FANOUT**level)
            first, last = np.minimum.reduceat(label, cut), np.maximum.reduceat(label, cut)
        else:
            first = last = label
        one = (first[left] == last[left]) & (first[right] == last[right]) & (first[left] == first[right])
        fits = ~one & (4 * high[left] >= 3 * low[right]) & (4 * high[right] >= 3 * low[left])
        left, right = left[fits], right[fits]
        kept = np.zeros(len(left), bool)
        for at in range(0, len(left), 4096):
            x, y = left[at : at + 4096], right[at : at + 4096]
            common_bits = np.bitwise_count(m[x] & m[y]).sum(1, dtype=np.int64)
            most = np.minimum(common_bits + np.minimum(gone[x], gone[y]), np.minimum(high[x], high[y]))
            kept[at : at + 4096] = 7 * most >= 3 * (low[x] + low[y])
        left, right = left[kept], right[kept]
        if level:
            n = len(levels[level - 1][0])
            for at in range(0, len(left), AT_ONCE):
                x, y = left[at : at + AT_ONCE, None, None] * FANOUT, right[at : at + AT_ONCE, None, None] * FANOUT
                x, y = np.broadcast_arrays(x + steps[:, None], y + steps)
                x, y = x.ravel(), y.ravel()
                fits = (y < n) & ((x <= y) if level > 1 else (x < y))
                walk(level - 1, x[fits], y[fits])
            return
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            if label[i] != label[j]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                    links.append((order[i], order[j]))
                    label[label == label[j]] = label[i]

    root = np.zeros(1, np.int64)
    if len(levels) > 1:
        walk(len(levels) - 1, root, root)
    return links


def _link_blocks(rows: DataFrame) -> DataFrame:
    """rows: block columns b1, b2, then key, class, grams -> links (a, b) between keys."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, classes, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            found = link_block(sets, np.array(classes, np.int64)) if len(keys) > 1 and len(set(classes)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.int64()), pa.array([keys[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for b1, b2, key, cls, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b1, b2) != block:
                    if len(keys) > 1:
                        yield out()
                    block, keys, classes, sets = (b1, b2), [], [], []
                keys.append(key)
                classes.append(cls)
                sets.append(np.frombuffer(grams, "<u8"))
        if len(keys) > 1:
            yield out()

    return rows.select("b1", "b2", "key", "class", "grams").repartition("b1", "b2").sortWithinPartitions("b1", "b2").mapInArrow(common.lean(link), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(key, class): the smallest key that links (a, b) reach; only keys with links. Large and small stars in turn, by sums over keys."""
    spark = links.sparkSession
    edges, path = common.staged_at(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after, next_path = common.staged_at(small, "edges")
        same = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        common.discard(spark, [path])
        edges, path = after, next_path
        if same:
            break
    keys = edges.groupBy("a").agg(F.min("b").alias("class")).select(F.col("a").alias("key"), "class")
    return common.staged(keys.unionByName(keys.select(F.col("class").alias("key"), "class").distinct()), "classes")


# ---- the join --------------------------------------------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_key(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int64())], names=["doc_id", "key", "n_shingles"])


def _meet(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, keys) by hash and key, each pair once, and which hashes more than one key has."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    h, k = h[new], k[new]
    same = h[1:] == h[:-1]
    return h, k, np.concatenate([same, [False]]) | np.concatenate([[False], same])


def _prefixes(docs: DataFrame, buckets: int) -> DataFrame:
    """Prefix shingles of all sets, packed by bucket of their hash: (bucket, hashes, keys).

    What more than one key of a task has is known to be shared: those pairs go to buckets of their keys, from ``buckets`` on, and only two
    of them to the bucket of the hash, so that a shingle that a great many texts have does not fill it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held, seen = 0, set()

        def out() -> pa.RecordBatch:
            h, k, shared = _meet(np.concatenate(hashes), np.concatenate(keys))
            first = np.concatenate([[True], h[1:] != h[:-1]])
            told = ~shared | first | np.concatenate([[False], first[:-1]])  # of shared ones the first two
            met = shared & ~told
            h, k = np.concatenate([h[told], h[met]]), np.concatenate([k[told], k[met]])
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            own = int(told.sum())
            bucket[own:] = buckets + (k[own:] % buckets)
            order = np.argsort(bucket, kind="stable")
            here, starts = np.unique(bucket[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            h8, k8 = h[order].astype("<u8"), k[order].astype("<i8")
            spans = list(zip(starts.tolist(), ends, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(here, pa.int32()), pa.array([h8[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([k8[i:j].tobytes() for i, j in spans], pa.binary())],
                names=["bucket", "hashes", "keys"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingles(text)
                key = _key(found)
                if not len(found) or key in seen:
                    continue
                if len(seen) < FLUSH:
                    seen.add(key)
                first = found[: prefix_length(len(found))]
                hashes.append(first)
                keys.append(np.full(len(first), key, np.int64))
                if (held := held + len(first)) > FLUSH:
                    yield out()
                    hashes, keys, held = [], [], 0
        if hashes:
            yield out()

    return docs.select("text").mapInArrow(common.lean(emit), "bucket int, hashes binary, keys binary")


def _met(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: the (key, token) whose hash more than one key has; tokens are the hashes. A pair may come more than once."""

    def met(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()])
        k = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("keys").to_pylist()])
        if table.column("bucket")[0].as_py() < buckets:
            h, k, shared = _meet(h, k)
            h, k = h[shared], k[shared]
        return pa.table({"key": pa.array(k, pa.int64()), "token": pa.array(h.view(np.int64), pa.int64())})

    return met


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, 100 * shared >= 75 * union of distinct 5-word shingles. Null texts
    and texts without words have no shingles and link with nothing. Rows that repeat are kept. Rows without a doc_id are
    named by those they share a shingle set with, and do not link any further. An empty table gives an empty one; other columns
    of ``docs`` are not kept; a text of any length is read whole, its set being one value. doc_id is a whole number.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", "text")
    sized = common.staged(docs.mapInArrow(common.lean(_sets), "doc_id long, key long, n_shingles long"), "sets")
    classes = sized.filter("n_shingles > 0").groupBy("key", "n_shingles").agg(F.min("doc_id").alias("rep"))

    buckets = 4 * common.partitions(spark)
    tokens = _prefixes(docs, buckets).groupBy("bucket").applyInArrow(_met(buckets), "key long, token long")
    n = F.col("n_shingles")
    needed = lambda x: F.ceil(x * 3 / F.lit(4))
    least = F.greatest(F.lit(1), F.floor(needed(n) / 6))
    left = tokens.groupBy("key").agg(F.collect_set("token").alias("tokens")).join(classes, "key").filter(F.size("tokens") >= least).withColumn("least", least)
    left = common.staged(left, "candidates")

    grams = _grams_of(docs, left)
    links, label = None, None
    for route in ("r1", "r2"):
        routed = grams.select("key", F.col(route).alias("b1"))
        routed = routed.withColumn("class", F.col("key")) if label is None else _labelled(routed, label)
        sizes = routed.groupBy("b1").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("b1", F.ceil(F.col("size") / BLOCK).alias("salts"))
        rows = routed.join(sizes, "b1").withColumn("b2", F.pmod(F.xxhash64(F.lit(route), "key"), F.col("salts")).cast("long"))
        found = common.staged(_link_blocks(rows.join(grams.select("key", "grams"), "key")), "links")
        links = found if links is None else links.unionByName(found)
        label = components(links)

    links = links.unionByName(_link_blocks(_remaining(left, label, grams)))
    label = components(links)
    named = _labelled(classes, label)
    lowest = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    by_key = named.join(lowest, "class").select("key", "n_shingles", "component_id")
    joined = sized.join(by_key, ["key", "n_shingles"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Adds class: what links say of the row's key, else the key itself."""
    return rows.join(label, "key", "left").withColumn("class", F.coalesce("class", "key"))


def _grams_of(docs: DataFrame, left: DataFrame) -> DataFrame:
    """(key, grams, r1, r2) of the classes that are left: the sorted hashes of a set and two minimal hashes."""
    wanted = left.select(F.col("rep").alias("doc_id"), "key", "n_shingles")
    few = wanted.count() <= SMALL_ENOUGH_TO_SEND

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                kept = [(k, f) for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) if _key(f := shingles(t)) == k]
                second = [int(_mixed(f * np.uint64(_Q)).min()) for _, f in kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in kept], pa.int64()), pa.array([f.astype("<u8").tobytes() for _, f in kept], pa.binary()), pa.array(np.array([int(f[0]) for _, f in kept], np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64))],
                    names=["key", "grams", "r1", "r2"],
                )

    found = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("key", "text")
    read_all = found.mapInArrow(common.lean(read), "key long, grams binary, r1 long, r2 long")
    return common.staged(read_all, "grams")


def _remaining(left: DataFrame, label: DataFrame, grams: DataFrame) -> DataFrame:
    """Blocks in which all classes that still share enough prefix shingles meet: b1, b2, key, class, grams.

    Of each set's tokens, rarest first, all but ``least - 1`` are looked at: one of them is shared with every partner, and
    the first that two partners share is among those of both.
    """
    labelled = _labelled(left.select("key", "n_shingles", "least", "tokens"), label)
    about = labelled.groupBy("class").agg(F.count("*").alias("members"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    held = labelled.select("key", "class", "least", F.explode("tokens").alias("token"))
    often = held.select("class", "token").distinct().groupBy("token").agg(F.count("*").alias("often")).filter("often > 1")
    by_key = Window.partitionBy("key")
    ranked = held.join(often, "token").withColumn("rank", F.row_number().over(by_key.orderBy("often", "token"))).withColumn("held", F.count("*").over(by_key))
    looked = common.staged(ranked.filter(F.col("rank") <= F.col("held") - F.col("least") + 1).select("token", "often", "key", "class"), "looked")
    rare = looked.filter(F.col("often") <= LISTED).select("token", "class").distinct().join(about, "class")
    other = rare.select("token", *(F.col(c).alias(f"{c}2") for c in ("class", "low", "high", "members")))
    pairs = rare.join(other, "token").filter((F.col("class") < F.col("class2")) & (4 * F.col("high") >= 3 * F.col("low2")) & (4 * F.col("high2") >= 3 * F.col("low")))
    pairs = pairs.select("class", "members", "class2", "members2").distinct()
    first = F.col("members") >= F.col("members2")
    pairs = common.staged(pairs.select(F.when(first, F.col("class")).otherwise(F.col("class2")).alias("big"), F.when(first, F.col("class2")).otherwise(F.col("class")).alias("small"), F.greatest("members", "members2").alias("members")), "pairs")
    salts = F.ceil(F.col("members") / (BLOCK // 2))
    members = labelled.select("class", "key")
    bigs = pairs.select("big", "members").distinct().join(members.withColumnRenamed("class", "big"), "big").select(F.col("big").alias("b1"), F.pmod(F.xxhash64(F.lit(3), "key"), salts).cast("long").alias("b2"), "key", F.col("big").alias("class"))
    smalls = pairs.join(members.withColumnRenamed("class", "small"), "small").select(F.col("big").alias("b1"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("b2"), "key", F.col("small").alias("class"))
    # a shingle that many classes have: the sets that look at it in blocks of two salts, every two salts in one
    held_by = looked.filter(F.col("often") > LISTED)
    sizes = held_by.groupBy("token").agg(F.ceil(F.count("*") / (BLOCK // 2)).alias("salts"))
    salted = held_by.join(sizes, "token").withColumn("salt", F.pmod(F.xxhash64(F.lit(4), "key"), F.col("salts")))
    both = F.transform(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda o: F.least(o, F.col("salt")) * F.col("salts") + F.greatest(o, F.col("salt")))
    met = salted.select(F.col("token").alias("b1"), F.explode(both).alias("b2"), "key", "class")
    return bigs.unionByName(smalls).unionByName(met).join(grams.select("key", "grams"), "key")


def op1_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and class of near duplicates: doc_id, n_shingles, component_id."""
    return near_duplicates(common.documents(spark, sf_dir))
