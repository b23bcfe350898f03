"""Catalogue search: spatial, temporal and property filters, paging, collections, granule ranking."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import footprints
from ..sources import shared

WORLD = (-180.0, -90.0, 180.0, 90.0)


def intersects(a: tuple[Column, Column, Column, Column], b: tuple, touching: bool = True) -> Column:
    """Rectangles (x0, y0, x1, y1) that meet; ``touching`` edges count, as for closed sets, or not."""
    if touching:
        return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def in_interval(ts: Column, interval: str) -> Column:
    """``start/end`` with ``..`` or nothing for an open end; a single instant means from then on."""
    start, _, end = interval.partition("/")
    found = F.lit(True)
    if start not in ("", ".."):
        found = found & (ts >= F.lit(start).cast("timestamp"))
    if "/" in interval and end not in ("", ".."):
        found = found & (ts <= F.lit(end).cast("timestamp"))
    return found


def property_path(name: str) -> str:
    """A JSON path to one property; anything but letters, digits and ``_:-.`` goes."""
    return "$['" + re.sub(r"[^a-zA-Z0-9_:\-.]", "", name) + "']"


def property_matches(properties: Column, name: str, rules: dict) -> Column:
    """The first of eq, gte, lte that is given: eq compares text, the others numbers; what is no number does not match."""
    found = F.get_json_object(properties, property_path(name))
    if "eq" in rules:
        return F.coalesce(found == str(rules["eq"]), F.lit(False))
    number = found.try_cast("double")
    if "gte" in rules:
        return F.coalesce(number >= float(rules["gte"]), F.lit(False))
    if "lte" in rules:
        return F.coalesce(number <= float(rules["lte"]), F.lit(False))
    return F.lit(True)


@dataclass
class Search:
    """A request; see the fields' filters above."""

    collections: list[str] = field(default_factory=list)
    bbox: tuple[float, float, float, float] | None = None
    datetime: str | None = None
    query: dict[str, dict] = field(default_factory=dict)
    limit: float | None = None
    offset: int = 0

    def page_size(self) -> int:
        return 25 if not self.limit or math.isnan(self.limit) else max(1, min(1000, int(self.limit)))


def matching(items: DataFrame, search: Search) -> DataFrame:
    """The items that a search matches, all pages."""
    found = items
    if search.collections:
        found = found.where(F.col("collection").isin(search.collections))
    if search.bbox:
        found = found.where(intersects(tuple(F.col("bbox")[k] for k in range(4)), search.bbox))
    if search.datetime:
        found = found.where(in_interval(F.col("datetime"), search.datetime))
    for name, rules in search.query.items():
        found = found.where(property_matches(F.col("properties"), name, rules))
    return found


def page(items: DataFrame, search: Search) -> DataFrame:
    """One page, newest first, ties by id."""
    return matching(items, search).orderBy(F.desc("datetime"), "id").offset(max(0, search.offset)).limit(search.page_size())


def has_next(items: DataFrame, search: Search) -> DataFrame:
    """One row: number_matched and whether another page follows."""
    return matching(items, search).agg(F.count("*").alias("number_matched")).withColumn("has_next", F.col("number_matched") > search.offset + search.page_size())


def collections(items: DataFrame) -> DataFrame:
    """Extent in space and time and size of each collection; the world where there is no finite extent."""
    edge = lambda f, k: F.coalesce(f(F.col("bbox")[k]), F.lit(WORLD[k]))
    return items.groupBy("collection").agg(F.count("*").alias("n"), F.min("datetime").alias("start"), F.max("datetime").alias("end"), edge(F.min, 0).alias("x0"), edge(F.min, 1).alias("y0"), edge(F.max, 2).alias("x1"), edge(F.max, 3).alias("y1"))


def coverage(ring: tuple[Column, Column, Column, Column], bbox: tuple[float, float, float, float]) -> Column:
    """Per cent of ``bbox`` that a rectangular footprint covers, 0 to 100."""
    w = F.least(ring[2], F.lit(bbox[2])) - F.greatest(ring[0], F.lit(bbox[0]))
    h = F.least(ring[3], F.lit(bbox[3])) - F.greatest(ring[1], F.lit(bbox[1]))
    area = (bbox[2] - bbox[0]) * (bbox[3] - bbox[1])
    return F.when((w > 0) & (h > 0), F.least(F.lit(100.0), w * h / area * 100)).otherwise(0.0)


def rank_granules(granules: DataFrame, bbox: tuple[float, float, float, float], most: int = 50) -> DataFrame:
    """The best granules for a box: coverage in steps of half a per cent, full frame, preferred mode, newest.

    Steps stand in for a tolerance of half a point, which is not an order.
    """
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    found = granules.where(intersects(box, bbox, touching=False)).withColumn("coverage", coverage(box, bbox))
    return found.orderBy(*best_first()).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*best_first())))


def best_first() -> list[Column]:
    return [F.desc(F.floor(F.col("coverage") * 2 + 0.5)), F.desc(F.col("full_frame")), F.desc(F.col("pol_mode") == "DHDH"), F.desc("start_ts"), F.col("id")]


def covered(rows: DataFrame, ring: str, box: tuple) -> DataFrame:
    """Adds coverage (per cent of the box, 0 to 100), corners (of what lies in it) and meets (whether extents touch).

    ``box``: x0, y0, x1, y1, each a number or the name of a column. Rings are cut in batches of flat arrays.
    """
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

    kept = [c for c in rows.columns if c not in ("coverage", "corners", "meets")]
    named = [F.col(b).cast("double") if isinstance(b, str) else F.lit(float(b)) for b in box]
    schema = StructType([*rows.select(*kept).schema.fields]).add("coverage", DoubleType()).add("corners", LongType()).add("meets", BooleanType())

    def cut(batches):
        for batch in batches:
            boxes = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[-5:-1]])
            share, corners, meets = footprints.cover(batch.column(batch.num_columns - 1), boxes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-5], pa.array(share), pa.array(corners), pa.array(meets)], names=schema.names)

    return rows.select(*kept, *(n.alias(f"_b{k}") for k, n in enumerate(named)), F.col(ring).cast(footprints.RING).alias("_ring")).mapInArrow(cut, schema)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, 1 for the first row in ``order``: rows are sorted by ranges of the whole order, so that ties in its first parts do
    not meet in one task, and numbered with the counts of the ranges before."""
    placed = shared.staged(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a task
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_part", "_at", "_before")


def resolve_granules(granules: DataFrame, place: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Granules with a data link whose extent meets a box, of the first collection (by ``place``) that has any, best first.

    ``granules``: id, url, ring, full_frame, pol_mode, start_ts. Those that meet the box without covering any of it come last. It is an
    error if there are none at all.
    """
    if not (bbox[0] < bbox[2] and bbox[1] < bbox[3]):
        raise ValueError(f"no box: {bbox}")
    usable = shared.staged(covered(granules.where(F.col("url").isNotNull()), "ring", bbox).where("meets").drop("meets", "ring"), "covered")
    if usable.isEmpty():
        raise ValueError(f"no granules for {bbox}")
    return numbered(first_hit(usable, place), best_first(), "rank")


def before(a: dict, b: dict, tolerance: float) -> bool:
    """Whether candidate ``a`` comes before ``b``: by coverage beyond the tolerance, then full frame, preferred mode, newest."""
    if abs(a["coverage"] - b["coverage"]) > tolerance:
        return a["coverage"] > b["coverage"]
    for key in ("full_frame", "lean"):
        if a[key] != b[key]:
            return a[key]
    return a["start"] > b["start"]


def stable_order(candidates: list[dict], tolerance: float) -> list[int]:
    """Places of a short list in the order of an insertion sort that looks for each one's place by halving.

    A tolerance makes no order (a may equal b and b equal c while a beats c), so which way of sorting is part of the result.
    """
    order: list[int] = []
    for i, one in enumerate(candidates):
        low, high = 0, len(order)
        while low < high:
            middle = (low + high) // 2
            if before(one, candidates[order[middle]], tolerance):
                high = middle
            else:
                low = middle + 1
        order.insert(low, i)
    return order


def resolve_requests(granules: DataFrame, requests: DataFrame, place: str, page: int = 25, tolerance: float = 0.5) -> DataFrame:
    """For each request (request, x0, y0, x1, y1) the first collection's candidates with rank, coverage and problem.

    Of each collection the ``page`` newest granules that meet the box are candidates, as catalogues return them; those without a data
    link go, then the first collection with any is ranked: coverage differences of up to ``tolerance`` points count as equal.
    Requests without a box, or without candidates, are one row with their problem. ``granules``: id, url, ring, place, full_frame,
    pol_mode, start_ts; extents (x0, y0, x1, y1) are taken from the rings first, and meet boxes by cells of ten degrees.
    """
    corner = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    cells = lambda a, b: F.sequence(F.floor(a / 10), F.floor(b / 10))
    boxed = requests.withColumn("ok", F.coalesce((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.lit(False)))
    asked = boxed.filter("ok").select("request", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    asked = asked.withColumn("cx", F.explode(cells(F.col("b_x0"), F.col("b_x1")))).withColumn("cy", F.explode(cells(F.col("b_y0"), F.col("b_y1"))))
    placed = granules.where("ring is not null and size(ring) > 0").select("id", "url", F.col(place).alias("place"), "full_frame", "pol_mode", "start_ts", "ring", *(corner(f, a).alias(n) for n, f, a in (("g_x0", F.array_min, "x"), ("g_y0", F.array_min, "y"), ("g_x1", F.array_max, "x"), ("g_y1", F.array_max, "y"))))
    placed = placed.withColumn("cx", F.explode(cells(F.col("g_x0"), F.col("g_x1")))).withColumn("cy", F.explode(cells(F.col("g_y0"), F.col("g_y1"))))
    first_cell = (F.col("cx") == F.floor(F.greatest("b_x0", "g_x0") / 10)) & (F.col("cy") == F.floor(F.greatest("b_y0", "g_y0") / 10))
    met = placed.join(asked, ["cx", "cy"]).filter((F.col("g_x0") <= F.col("b_x1")) & (F.col("g_x1") >= F.col("b_x0")) & (F.col("g_y0") <= F.col("b_y1")) & (F.col("g_y1") >= F.col("b_y0")) & first_cell)
    newest = Window.partitionBy("request", "place").orderBy(F.desc("start_ts"), "id")
    paged = met.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= page).filter("url is not null")
    best = Window.partitionBy("request")
    own = covered(paged.withColumn("_best", F.min("place").over(best)).filter("place = _best").drop("_best"), "ring", ("b_x0", "b_y0", "b_x1", "b_y1"))

    def rank(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["_k"])
        for r in rows:
            r["lean"], r["start"] = r["pol_mode"] == "DHDH", r["start_ts"].timestamp() if r["start_ts"] else 0.0
        order = stable_order(rows, tolerance)
        found = table.take(pa.array([table.column("_k").to_pylist().index(rows[i]["_k"]) for i in order])).select(["request", "id", "coverage"])
        return found.append_column("rank", pa.array(range(1, len(order) + 1), pa.int32()))

    kinds = {c: granules.schema["id"].dataType.simpleString() if c == "id" else requests.schema["request"].dataType.simpleString() for c in ("request", "id")}
    ranked = own.select("request", "id", "coverage", "full_frame", "pol_mode", "start_ts", "_k").groupBy("request").applyInArrow(rank, f"request {kinds['request']}, id {kinds['id']}, coverage double, rank int")  # a page at most
    missing = boxed.join(ranked.select("request").distinct().withColumn("_there", F.lit(True)), "request", "left").filter("_there is null")
    told = missing.select("request", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("int").alias("rank"), F.when(~F.col("ok"), "no box").otherwise("no granules").alias("problem"))
    return ranked.withColumn("problem", F.lit(None).cast("string")).unionByName(told)


def first_hit(rows: DataFrame, priority: str) -> DataFrame:
    """Rows of the collection that comes first among those with rows."""
    best = rows.agg(F.min(priority).alias("_best"))
    return rows.join(F.broadcast(best), F.col(priority) == F.col("_best")).drop("_best")  # one row


def beyond_budget(entries: DataFrame, most_bytes: int, keys: list[str], span: int = 1000) -> DataFrame:
    """Entries that no longer fit into ``most_bytes`` of each key when the newest are kept first, with the bytes up to each.

    ``entries``: keys, id, bytes, at (a whole number, newest highest). Sums over spans of ``at`` come first, so that running
    sums only go over rows of one span, whatever share of the rows a key has.
    """
    parted = entries.withColumn("_span", F.floor(F.col("at") / span))
    sums = parted.groupBy(*keys, "_span").agg(F.sum("bytes").alias("_bytes"))
    newer = F.sum("_bytes").over(Window.partitionBy(*keys).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_span").alias("_at"), F.coalesce(newer, F.lit(0)).alias("_newer"))
    same = F.col("_span") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.sum("bytes").over(Window.partitionBy(*keys, "_span").orderBy(F.desc("at"), "id"))
    met = parted.join(sums, same).withColumn("kept_bytes", F.col("_newer") + within)
    return met.where(F.col("kept_bytes") > most_bytes).drop("_span", "_at", "_newer", *(f"_{k}" for k in keys))


def sorted_entries(entries: DataFrame, folder: str) -> DataFrame:
    """Adds directory (a name that ends in a slash, of size 0) and place (from 1) in each folder: directories, then files, by name."""
    marked = entries.withColumn("directory", F.col("name").endswith("/")).withColumn("size", F.when(F.col("directory"), F.lit(0).cast("long")).otherwise(F.col("size")))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(folder).orderBy(F.desc("directory"), "name", "size")).cast("long"))
