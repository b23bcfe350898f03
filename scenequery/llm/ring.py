"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

Keys are inserted in the order of their hash. A key goes to the first shard clockwise that still has room; every shard
has room for its share of the rows, so all counts are at most one apart, and only overflowing keys leave their place.

The ring has a fixed number of places, so a count per (arc, step of the insertion order) is a table of at most
``2 * VNODES * shards`` arcs by ``STEPS`` whatever the input. The overflow is worked out on those counts: it says for each cell
which ranks go to which shard, from which slot on. Rows then take shard and slot from their rank within their cell: they are sorted
by ranges of the whole order, ties included, so a key that a great share of the rows have is spread over tasks too.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PLACES = 4096
VNODES = 24
STEPS = 64
SEED = 20


def ring(shards: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, clockwise. A shard's own nodes do not depend on how many shards there are."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(VNODES):
            place = int(hashlib.sha256(f"{shard}/{v}".encode()).hexdigest()[:8], 16) % PLACES
            at.setdefault(place, shard)
    return sorted(at.items())


def overflow(nodes: list[tuple[int, int]], counts: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, step, first rank, shard, first slot): counts has the keys of each (arc, step), room the rows each shard takes."""
    found, used = [], [0] * len(room)
    for arc, step in sorted(counts, key=lambda c: (c[1], c[0])):
        left, rank, k = counts[arc, step], 0, arc
        while left:
            shard = nodes[k % len(nodes)][1]
            take = min(left, room[shard] - used[shard])
            if take:
                found.append((arc, step, rank, shard, used[shard]))
                used[shard] += take
                rank += take
                left -= take
            k += 1
    return found


def assign(keyed: DataFrame, key: str, shards: int, ties: list[str]) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard); columns that already have these names are replaced. Rows with the same key are ordered by ``ties``; a null key is a key.

    Rows that repeat take a slot each, an empty table gives an empty one, other columns stay. Texts do not count here.

    Law: with n rows, every shard gets n // shards or one more.
    """
    spark = keyed.sparkSession
    nodes = ring(shards)
    places = [place for place, _ in nodes]
    arc_of, arc = [], 0
    for place in range(PLACES):
        while arc < len(places) and places[arc] < place:
            arc += 1
        arc_of.append(arc % len(nodes))
    table = F.lit(arc_of)
    kept = [c for c in keyed.columns if c not in ("shard", "slot")]
    packed = keyed.select(F.col(key).alias("_key"), F.struct(*ties).alias("_ties") if ties else F.lit(0).alias("_ties"), F.struct(*kept).alias("_row"))
    placed = packed.withColumn("_h", F.xxhash64(F.lit(SEED), "_key")).withColumn("_arc", F.element_at(table, (F.pmod("_h", F.lit(PLACES)) + 1).cast("int"))).withColumn("_step", F.pmod(F.shiftrightunsigned("_h", 12), F.lit(STEPS)).cast("int"))
    order = ("_arc", "_step", "_h", "_key", "_ties")
    ranged = placed.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = common.staged(ranged, "ring").withColumn("_part", F.shiftright("_at", 33))
    counts = {(r["_arc"], r["_step"]): r["count"] for r in placed.groupBy("_arc", "_step").count().collect()}
    n = sum(counts.values())
    cells = overflow(nodes, counts, [n // shards + (s < n % shards) for s in range(shards)])
    spans = spark.createDataFrame(cells, "_arc int, _step int, first long, shard int, slot long")
    spans = spans.groupBy("_arc", "_step").agg(F.sort_array(F.collect_list(F.struct("first", "shard", "slot"))).alias("_spans"))
    # a range of rows holds a stretch of each of its cells; rows count from where the cell's stretches before end
    stretches = placed.groupBy("_part", "_arc", "_step").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # cells and ranges, no more
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_arc", "_step").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.withColumn("_before", before).drop("_n")
    ranked = placed.join(F.broadcast(stretches), ["_part", "_arc", "_step"]).withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first"))
    joined = ranked.join(F.broadcast(spans), ["_arc", "_step"]).withColumn("_span", F.element_at(F.filter("_spans", lambda s: s["first"] <= F.col("_rank")), -1))
    return joined.select("_row.*", F.col("_span.shard").alias("shard"), (F.col("_span.slot") + F.col("_rank") - F.col("_span.first")).alias("slot"))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    docs = common.documents(spark, sf_dir)
    sized = docs.select("doc_id", (F.octet_length(common.text_or_empty()) + 1).cast("long").alias("size"), F.crc32(common.text_or_empty().cast("binary")).alias("text_crc32"))
    return assign(sized, "doc_id", 8, ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
