"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Each source's documents are dealt to shards by a seeded hash; a shard's documents, in seeded order, are one stream of
words cut into blocks of ``BLOCK_WORDS``. Blocks go to sources, then to each source's shards, by highest quotients. A
shard that gets q of its b blocks takes all of them q // b times and q % b more, chosen by a seeded permutation.

Only sums per source and per shard of a source reach the driver: at most ``MOST_SHARDS`` a source, so sources are taken
to be a dimension of a few thousand values at most. A source too large for that many shards of ``SHARD_WORDS`` has as many, and
longer ones; no row is left out. Quotas are broadcast up to ``MOST_SENT`` rows and joined by a shuffle beyond that.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_WORDS = 64
SHARD_WORDS = 1 << 17
MOST_SHARDS = 4096
MOST_SENT = 100_000  # quotas, of some 60 bytes each
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = 9
COPY_UNIT = 1 << 20  # copies are carried in whole parts of this


def mix_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Share ``share`` times all sizes by weight; a target stops at ``most`` times its size, the excess is reshared by weight."""
    targets = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s], share * sum(sizes)
    for i in range(len(sizes)):
        targets[i] = 0.0
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1); a party stops at its ``most``. Ties go to the earlier party."""
    v, cap = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = min(seats, int(cap[v > 0].sum()))
    at = lambda d: np.minimum(np.floor(v / d + 0.5), cap).astype(np.int64)
    if not seats:
        return [0] * len(v)
    low, high = v[v > 0].min() / (2 * cap.max() + 2), 3 * v.sum() + 1
    for _ in range(200):  # the divisor, from above: never more seats than there are
        mid = (low + high) / 2
        low, high = (low, mid) if at(mid).sum() <= seats else (mid, high)
    got = at(high)
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if v[i] > 0 and got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return got.tolist()


def _permutation(blocks: int, key: str) -> tuple[int, int]:
    """A seeded multiplier prime to ``blocks``, and an offset: k -> (k * multiplier + offset) mod blocks."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:12], 16)
    m = h % blocks or 1
    while math.gcd(m, blocks) > 1:
        m = m % blocks + 1
    return m, (h >> 20) % blocks


def word_count(column: str = "text"):
    return F.regexp_count(common.text_or_empty(column), F.lit(common.WORD)).cast("long")


def _copies(seed: int):
    """How often each document is taken as a whole, for rows placed in shards: taken / size, rounded up or down.

    A shard's documents, longest first, carry the remainder along from a seeded start, so neighbours of similar length make
    up for each other: a shard's whole documents differ from its taken words by less than its longest document, and no way
    on average.
    """
    shard = Window.partitionBy("_s", "_shard").orderBy(F.desc("size"), "_h", "doc_id", "taken", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratio = F.when(F.col("size") > 0, F.round(F.col("taken") * COPY_UNIT / F.col("size"))).otherwise(0).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("copies"), "_s", "_shard"), F.lit(COPY_UNIT))
    upto = F.sum(ratio).over(shard) + start
    return (F.floor(upto / COPY_UNIT) - F.floor((upto - ratio) / COPY_UNIT)).cast("int")


def mix(docs: DataFrame, seed: int = SEED, prefix: str = "", copies: bool = False) -> DataFrame:
    """Adds size, source_size, target and taken (and copies) to every row of ``docs`` (doc_id, text, source).

    The new names start with ``prefix``; a column that already has such a name is replaced. Other columns stay.

    taken: the words the mix takes of the document, from 0 to twice its size. A null text has no words, as an empty one; null
    is a source of its own, the last; rows with the same or no doc_id are rows of their own, in the order of a hash of all
    their columns. The same rows give the same mix, in any order and partitioning; an empty table gives an empty one.

    copies: how often to take the document where only whole ones can be taken: 0, 1 or 2 times, taken / size rounded such
    that a shard's words are met.
    """
    added = ["size", "source_size", "target", "taken", "copies"][: 4 + copies]
    kept = [c for c in docs.columns if c not in {prefix + a for a in added}]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name in kept and "map<" not in f.dataType.simpleString()]
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit(seed), *hashed).alias("_tie"), F.struct(*(f"`{c}`" for c in kept)).alias("_row"))
    return _mixed(sized, seed, copies).select("_row.*", *(F.col(a).alias(prefix + a) for a in added))


def _mixed(sized: DataFrame, seed: int, copies: bool = False) -> DataFrame:
    """``sized`` (doc_id, source, size, _tie and others) is read three times: sums by source, sums by shard, rows."""
    spark = sized.sparkSession
    small = lambda df, n: F.broadcast(df) if n <= MOST_SENT else df
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    targets = mix_targets([r["n"] for r in totals], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))])
    sources = [(i, r["source"], r["n"], t, max(1, min(MOST_SHARDS, math.ceil(r["n"] / SHARD_WORDS)))) for i, (r, t) in enumerate(zip(totals, targets, strict=True))]
    by_source = spark.createDataFrame(sources, "_s int, _source string, source_size long, target double, _shards int")
    dealt = sized.join(small(by_source, len(sources)), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    dealt = dealt.withColumn("_shard", F.pmod("_h", F.col("_shards")).cast("int"))
    cells = sorted((r["_s"], r["_shard"], r["n"]) for r in dealt.groupBy("_s", "_shard").agg(F.sum("size").alias("n")).collect())
    blocks = [math.ceil(n / BLOCK_WORDS) for _, _, n in cells]
    own: list[list[int]] = [[] for _ in sources]
    for i, (s, _, _) in enumerate(cells):
        own[s].append(i)
    most = [sum(int(MOST * blocks[i]) for i in here) for here in own]
    seats = sainte_lague(targets, round(sum(targets) / BLOCK_WORDS), most)
    quotas: list[tuple] = []
    for s, here in enumerate(own):
        for i, q in zip(here, sainte_lague([cells[i][2] for i in here], seats[s], [int(MOST * blocks[i]) for i in here]), strict=True):
            m, o = _permutation(blocks[i], f"{seed}/{cells[i][:2]}") if blocks[i] else (1, 0)
            quotas.append((*cells[i][:2], max(1, blocks[i]), q // max(1, blocks[i]), q % max(1, blocks[i]), m, o))
    by_cell = spark.createDataFrame(quotas, "_s int, _shard int, _blocks long, _full long, _more long, _m long, _o long")
    stream = Window.partitionBy("_s", "_shard").orderBy("_h", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(small(by_cell, len(quotas)), ["_s", "_shard"]).withColumn("_from", F.coalesce(F.sum("size").over(stream), F.lit(0))).withColumn("_to", F.col("_from") + F.col("size"))
    size = F.lit(BLOCK_WORDS)
    chosen = lambda k: F.pmod(k * F.col("_m") + F.col("_o"), F.col("_blocks")) < F.col("_more")
    overlap = lambda k: F.least((k + 1) * size, F.col("_to")) - F.greatest(k * size, F.col("_from"))
    touched = F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))
    partly = F.aggregate(touched, F.lit(0).cast("long"), lambda acc, k: acc + F.when(chosen(k), overlap(k)).otherwise(F.lit(0)))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("_full") * F.col("size") + partly).cast("long")
    placed = placed.withColumn("taken", taken)
    return placed.withColumn("copies", _copies(seed)) if copies else placed


def op9_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken. Texts are counted once, and do not go along."""
    docs = common.documents(spark, sf_dir)
    sized = common.staged(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "text", "source").alias("_tie")), "sizes")
    return _mixed(sized, SEED).select("doc_id", "size", "source_size", "target", "taken")
