"""Hard negatives by blocks of vectors in Hilbert-curve order, of which zone maps tell what an anchor must read.

Rows are sorted by label and place on a Hilbert curve through the dimensions that vary most, and cut into blocks, one Parquet row
each: vectors, ids, labels, and a zone map with the least and largest value of each dimension. For an anchor a, interval arithmetic
on a zone map gives bounds of a . x over the block's rows. From these alone follows which blocks must be read:

* positives: if blocks of the anchor's label whose lower bounds reach s hold more than ``positives`` rows, only blocks whose upper
  bound reaches s can hold one of them;
* negatives: blocks of other labels whose bounds meet one of the anchor's windows; and if blocks that lie wholly in a window with
  lower bounds from s on hold ``negatives`` rows, only those whose upper bound reaches s can hold what that window returns.

Anchors travel in groups. Zone maps are planned on in pages, and a block's page is read together with the groups that must read
it, so a task holds one page and one group at a time. Each page gives the best few of every anchor, which are merged as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

SCALE, LEAST_PERCENT, MOST_PERCENT = 256, 30, 90
CURVE_DIMS, CURVE_BITS = 8, 7  # of a place on the curve; both together stay below 63 bits
BLOCK_BYTES = 64 << 10
PAGE_BLOCKS = 32
ZONE_BYTES = 1 << 19
GROUP = 128
NONE = np.iinfo(np.int64).min

BLOCK = "block long, n int, low_label long, high_label long, low binary, high binary, ids binary, labels binary, x binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers (0 to 2**bits - 1): neighbours along the curve are neighbouring cells.

    By Gray codes: the curve visits the corners of a cube in Gray-code order, each sub-cube turned by where it is entered.
    """
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    one = np.uint64(1)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        below = np.uint64(level - 1)
        for d in range(dims):
            high = (x[d] & np.uint64(level)) != 0
            swapped = (x[0] ^ x[d]) & below
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swapped)
            if d:
                x[d] = np.where(high, x[d], x[d] ^ swapped)
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turned = np.zeros_like(x[0])
    level = top
    while level > 1:
        turned = np.where((x[dims - 1] & np.uint64(level)) != 0, turned ^ np.uint64(level - 1), turned)
        level >>= 1
    x ^= turned
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << one) | ((x[d] >> np.uint64(bit)) & one)
    return place.astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible a . x for rows of ``a`` and x between ``low`` and ``high``; widened by more than doubles can be off."""
    up, down = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float)
    low, high = low.astype(float).T, high.astype(float).T
    slack = 1e-12 * (np.abs(a).astype(float) @ np.maximum(np.abs(low), np.abs(high)))
    return up @ low + down @ high - slack, up @ high + down @ low + slack


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a x', exact: in doubles where those add whole numbers exactly, in 64-bit numbers beyond that."""
    most = float(np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (x.astype(float) ** 2).sum(1).max(initial=0)))
    if most < 2.0**23:
        return (a.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2.0**52:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**56:
        raise ValueError("inner products must stay below 2 to the power 56")
    return a @ x.T


# ---- blocks ----------------------------------------------------------------------------------------------------------------


def _spread(numbered: DataFrame, dims: int) -> tuple[list[int], list[float], list[float]]:
    """The dimensions that vary most, and the range of each."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v = vectors.matrix(batch.column(0), dims)
            if len(v):
                own = np.stack([np.full(dims, float(len(v))), v.sum(0), (v * v).sum(0), v.min(0), v.max(0)])
                total = own if total is None else np.stack([*(total[:3] + own[:3]), np.minimum(total[3], own[3]), np.maximum(total[4], own[4])])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), *(pa.array(t, pa.float64()) for t in total)], names=["d", "n", "s", "q", "low", "high"])

    rows = numbered.select("_vector").mapInArrow(common.lean(sums), "d int, n double, s double, q double, low double, high double")
    by_dim = rows.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(by_dim.collect(), key=lambda r: (-(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2), r["d"]))[:CURVE_DIMS]
    return [r["d"] for r in found], [r["low"] for r in found], [r["high"] for r in found]


def _placed(numbered: DataFrame, dims: int, scale: int) -> DataFrame:
    """(id, label, place, x): vectors as packed whole numbers and their place on the curve."""
    axes, low, high = _spread(numbered, dims)
    span = np.maximum(np.array(high) - np.array(low), 1e-300)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors.matrix(batch.column(2), dims)
            x = vectors.floored(v, scale)
            cells = np.clip((v[:, axes] - low) / span * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            at = hilbert(cells, CURVE_BITS) if axes else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array([r.astype("<i8").tobytes() for r in x], pa.binary())], names=["id", "label", "place", "x"])

    return numbered.select("id", "label", "_vector").mapInArrow(common.lean(place), "id long, label long, place long, x binary")


def _numbers(rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(-1, dims) if dims else np.zeros((len(rows), 0), np.int64)


def _blocks(placed: DataFrame, dims: int) -> DataFrame:
    size = max(8, BLOCK_BYTES // (8 * max(dims, 1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, base = [], 0, 0

        def out(rows: list) -> pa.RecordBatch:
            nonlocal number
            rows.sort(key=lambda r: r[0])  # within a block rows are by id
            x = _numbers([r[2] for r in rows], dims)
            ids, labels = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8")
            values = (base << 32 | number, len(rows), int(labels.min()), int(labels.max()), x.min(0).tobytes(), x.max(0).tobytes(), ids.tobytes(), labels.tobytes(), x.tobytes())
            number += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema=schema)

        names = [c.split()[0] for c in BLOCK.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in BLOCK.split(", ")])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "x", "part")), strict=True):
                base = row[3]
                held.append(row)
                if len(held) == size:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    ordered = placed.repartitionByRange(common.partitions(placed.sparkSession), "label", "place", "id").sortWithinPartitions("label", "place", "id")
    return ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(common.lean(cut), BLOCK)


def _groups(placed: DataFrame, every: int, dims: int) -> DataFrame:
    """Anchors in groups of neighbours: (grp, ids, labels, x)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, base = [], 0, 0

        def out(rows: list) -> pa.RecordBatch:
            columns = [pa.array([base << 32 | number], pa.int64()), *(pa.array([np.array([r[i] for r in rows], "<i8").tobytes()], pa.binary()) for i in (0, 1)), pa.array([b"".join(r[2] for r in rows)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["grp", "ids", "labels", "x"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "x", "part")), strict=True):
                base = row[3]
                held.append(row)
                if len(held) == GROUP:
                    yield out(held)
                    held, number = [], number + 1
        if held:
            yield out(held)

    anchors = placed.filter(F.pmod("id", F.lit(every)) == 0)
    parts = max(1, common.partitions(placed.sparkSession) // 8)
    ordered = anchors.repartitionByRange(parts, "label", "place", "id").sortWithinPartitions("label", "place", "id")
    return ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(common.lean(pack), "grp long, ids binary, labels binary, x binary")


# ---- what is asked of a block ----------------------------------------------------------------------------------------------


class Asked:
    """A group of anchors with what they look for: the windows of scores [floor, top] of each, and how many of each window.

    Positives are one window without bounds among rows of the anchor's label; negatives as many as there are positives, among rows
    of other labels. A window that is not there has a floor above its top.
    """

    def __init__(self, row: dict, dims: int, many: int, copies: int):
        self.copies = copies  # rows of an anchor's own id, at most
        self.ids, self.labels, self.many = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), many
        self.x = np.frombuffer(row["x"], "<i8").reshape(len(self.ids), dims)
        self.same = row["floors"] is None
        if self.same:
            self.floors, self.tops = np.full((len(self.ids), 1), NONE // 4), np.full((len(self.ids), 1), -(NONE // 4))
        else:
            self.floors, self.tops = (np.frombuffer(row[k], "<i8").reshape(len(self.ids), -1) for k in ("floors", "tops"))

    def blocks(self, zones: list[dict], dims: int) -> np.ndarray:
        """Which blocks each anchor must read: (anchor, block) mask."""
        low, high = (np.frombuffer(b"".join(z[k] for z in zones), "<i8").reshape(len(zones), dims) for k in ("low", "high"))
        n, first, last = (np.array([z[k] for z in zones], np.int64) for k in ("n", "low_label", "high_label"))
        least, most = bounds(self.x, low, high)
        label = self.labels[:, None]
        if self.same:
            may, sure = (first <= label) & (label <= last), (first == label) & (label == last)
        else:
            may, sure = ~((first == label) & (label == last)), (label < first) | (last < label)
        wanted = np.zeros(may.shape, bool)
        for w in range(self.floors.shape[1]):
            floor, top = self.floors[:, w : w + 1], self.tops[:, w : w + 1]
            meets = may & (most >= floor) & (least <= top) & (floor <= top)
            inside = np.where(sure & (least >= floor) & (most <= top), least, -np.inf)
            order = np.argsort(-inside, axis=1, kind="stable")
            ranked = np.take_along_axis(inside, order, 1)
            enough = np.cumsum(n[order], axis=1) >= self.many + self.copies * self.same  # some may be of the anchor's id
            at = np.where(enough.any(1), enough.argmax(1), 0)
            reach = np.where(enough.any(1), ranked[np.arange(len(at)), at], -np.inf)
            wanted |= meets & (most >= reach[:, None])
        return wanted

    def best(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, reads: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the first ``many`` rows in each anchor's windows, window after window; rows are by id, ``reads`` masks them by anchor."""
        scores = products(self.x, x)
        fits = reads & ((labels == self.labels[:, None]) & (ids != self.ids[:, None]) if self.same else labels != self.labels[:, None])
        found = []
        for i in range(len(self.ids)):
            own = np.flatnonzero(fits[i] & (scores[i] >= self.floors[i].min()) & (scores[i] <= self.tops[i].max()))
            own = own[np.argsort(-scores[i, own], kind="stable")]
            falling = -scores[i, own]
            for floor, top in zip(self.floors[i].tolist(), self.tops[i].tolist(), strict=True):
                a = np.searchsorted(falling, -top)
                b = min(np.searchsorted(falling, -floor, side="right"), a + self.many)
                found.append((ids[own[a:b]], scores[i, own[a:b]]) if a < b else (ids[:0], scores[i, :0]))
        return found


def _list_pages(blocks: DataFrame, last: int, groups: DataFrame, dims: int, many: int, copies: int) -> DataFrame:
    """(block, page, grp, who): the blocks that each group must read, and which of its anchors must, as a bitmap."""
    page = max(64, ZONE_BYTES // (16 * max(dims, 1)))
    pages = F.sequence(F.lit(0).cast("long"), F.lit(max(0, last) // page).cast("long"))
    zones = blocks.select("number", "block", "n", "low_label", "high_label", "low", "high", (F.col("number") / page).cast("long").alias("zone_page"))
    asked = groups.select("grp", "ids", "labels", "x", "floors", "tops", F.explode(pages).alias("zone_page"))
    both = zones.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["zone_page"] != here:
                here, held = row["zone_page"], []
            if not row["asks"]:
                held.append(row)
                continue
            mask = Asked(row, dims, many, copies).blocks(held, dims)
            wanted = np.flatnonzero(mask.any(0)).tolist()
            if wanted:
                columns = [pa.array([held[b]["block"] for b in wanted], pa.int64()), pa.array([held[b]["number"] // PAGE_BLOCKS for b in wanted], pa.int64())]
                columns += [pa.array([row["grp"]] * len(wanted), pa.int64()), pa.array([np.packbits(mask[:, b]).tobytes() for b in wanted], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "page", "grp", "who"])

    dealt = both.repartition(common.partitions(blocks.sparkSession), "zone_page").sortWithinPartitions("zone_page", "asks", "number", "grp")
    return dealt.mapInArrow(common.lean(plan), "block long, page long, grp long, who binary")


FOUND = "grp long, place int, ids binary, scores binary"


def _read(blocks: DataFrame, last: int, groups: DataFrame, dims: int, many: int, copies: int) -> DataFrame:
    """(grp, place, ids, scores): the first ``many`` of each window of each anchor; place numbers windows through a group's anchors."""
    reads = common.staged(_list_pages(blocks, last, groups, dims, many, copies), "reads")
    needed = blocks.join(reads.select("block").distinct(), "block", "left_semi").select("number", "block", F.col("ids").alias("block_ids"), F.col("labels").alias("block_labels"), F.col("x").alias("block_x"), (F.col("number") / PAGE_BLOCKS).cast("long").alias("page"))
    asking = reads.groupBy("page", "grp").agg(F.collect_list(F.struct("block", "who")).alias("reads")).join(groups, "grp")  # a page's blocks at most
    both = needed.withColumn("asks", F.lit(0)).unionByName(asking.withColumn("asks", F.lit(1)), allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["page"] != here:
                here, held = row["page"], {}
            if not row["asks"]:
                held[row["block"]] = (np.frombuffer(row["block_ids"], "<i8"), np.frombuffer(row["block_labels"], "<i8"), np.frombuffer(row["block_x"], "<i8").reshape(-1, dims))
                continue
            asked = Asked(row, dims, many, copies)
            ids, labels, x = (np.concatenate([held[r["block"]][i] for r in row["reads"]]) for i in range(3))
            who = np.stack([np.unpackbits(np.frombuffer(r["who"], np.uint8), count=len(asked.ids)).astype(bool) for r in row["reads"]], 1)
            mask = np.repeat(who, [len(held[r["block"]][0]) for r in row["reads"]], axis=1)
            order = np.argsort(ids, kind="stable")
            found = asked.best(ids[order], labels[order], x[order], mask[:, order])
            some = [i for i, (own, _) in enumerate(found) if len(own)]
            columns = [pa.array([row["grp"]] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array([found[i][k].astype("<i8").tobytes() for i in some], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "place", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, scores = None, np.zeros(0, "<i8"), np.zeros(0, "<i8")

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here[0]], pa.int64()), pa.array([here[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([scores.tobytes()], pa.binary())], names=["grp", "place", "ids", "scores"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["grp"], row["place"]) != here:
                    if here is not None:
                        yield out()
                    here, ids, scores = (row["grp"], row["place"]), np.zeros(0, "<i8"), np.zeros(0, "<i8")
                ids, scores = np.concatenate([ids, np.frombuffer(row["ids"], "<i8")]), np.concatenate([scores, np.frombuffer(row["scores"], "<i8")])
                best = np.lexsort((ids, -scores))[:many]
                ids, scores = ids[best], scores[best]
        if here is not None:
            yield out()

    n = common.partitions(blocks.sparkSession)
    dealt = both.repartition(n, "page").sortWithinPartitions("page", "asks", "block", "grp")
    parts = dealt.mapInArrow(common.lean(search), FOUND)
    return parts.repartition(n, "grp", "place").sortWithinPartitions("grp", "place").mapInArrow(common.lean(merge), FOUND)


def _windows(positives: DataFrame, many: int, least: int, most: int) -> DataFrame:
    """(grp, places, floors, tops): for each group its anchors' places with the windows that their positives open."""
    from pyspark.sql.types import BinaryType, LongType, StructType

    def open_(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        floors, tops = (np.full((GROUP, many), v, "<i8") for v in (1, 0))
        for row in rows:
            p = np.frombuffer(row["scores"], "<i8")
            floors[row["place"], : len(p)] = -((-least * p) // 100)
            tops[row["place"], : len(p)] = (most * p) // 100
        return pa.table({"grp": [rows[0]["grp"]], "floors": [floors.tobytes()], "tops": [tops.tobytes()]})

    schema = StructType().add("grp", LongType()).add("floors", BinaryType()).add("tops", BinaryType())
    return positives.groupBy("grp").applyInArrow(open_, schema)  # a group has GROUP anchors at most


def mine(rows: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10, scale: int = SCALE, least: int = LEAST_PERCENT, most: int = MOST_PERCENT) -> DataFrame:
    """Hard negatives of all rows whose id is divisible by ``every``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(scale * c); a score is the inner product with the anchor; higher scores come first, then smaller ids. An
    anchor's positives are its first ``positives`` other rows of the same label. For each, the first ``negatives`` rows of other labels
    with least * positive_score <= 100 * negative_score <= most * positive_score are returned.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Shorter vectors are filled up
    with zeros. Rows that repeat an id are candidates each, but an anchor is never its own id's positive; a repeated anchor gives
    its rows as often. Anchors without positives or without rows in a window give none, as does an empty table. Other columns are
    not kept. ids and labels are whole numbers; a component of 2 to the power 62 or a product of 2 to the power 56 is an error.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    numbered = vectors.usable(rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("_vector")), "_vector").filter("id is not null and label is not null")
    dims = vectors.longest(numbered, "_vector")
    placed = common.staged(_placed(numbered, dims, scale), "placed")
    blocks = common.staged(_blocks(placed, dims), "blocks")
    # blocks are numbered through along the curve: as many counts as the table has parts
    counts = {r["part"]: r["n"] for r in blocks.groupBy(F.shiftright("block", 32).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    first = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    blocks = blocks.withColumn("part", F.shiftright("block", 32)).join(first, "part").withColumn("number", F.col("before") + F.col("block").bitwiseAND(0xFFFFFFFF)).drop("part", "before")
    groups = common.staged(_groups(placed, every, dims), "anchors")
    anchors = placed.filter(F.pmod("id", F.lit(every)) == 0)
    copies = anchors.groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("n")).collect()[0]["n"]
    unasked = groups.withColumn("floors", F.lit(None).cast("binary")).withColumn("tops", F.lit(None).cast("binary"))
    near = common.staged(_read(blocks, before - 1, unasked, dims, positives, copies), "positives")
    asking = groups.join(_windows(near, positives, least, most), "grp")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"]) // 8
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]], pa.int64()), *(pa.array([row[k]], pa.binary()) for k in ("ids", "labels", "x")), *(pa.array([row[k][: 8 * positives * n]], pa.binary()) for k in ("floors", "tops"))], names=["grp", "ids", "labels", "x", "floors", "tops"])

    asking = common.staged(asking.mapInArrow(cut, "grp long, ids binary, labels binary, x binary, floors binary, tops binary"), "windows")
    far = _read(blocks, before - 1, asking, dims, negatives, copies)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                anchor = np.frombuffer(row["anchors"], "<i8")[row["place"] // positives]
                which = row["place"] % positives
                one, score = (int(np.frombuffer(row[k], "<i8")[which]) for k in ("near_ids", "near_scores"))
                for rank, (other, s) in enumerate(zip(np.frombuffer(row["ids"], "<i8").tolist(), np.frombuffer(row["scores"], "<i8").tolist(), strict=True), 1):
                    out.append((int(anchor), one, rank, other, score, s))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    told = near.select("grp", F.col("place").alias("anchor"), F.col("ids").alias("near_ids"), F.col("scores").alias("near_scores"))
    joined = far.withColumn("anchor", (F.col("place") / positives).cast("int")).join(told, ["grp", "anchor"]).join(groups.select("grp", F.col("ids").alias("anchors")), "grp")
    return joined.select("place", "ids", "scores", "near_ids", "near_scores", "anchors").mapInArrow(common.lean(spell), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector among all: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"))
