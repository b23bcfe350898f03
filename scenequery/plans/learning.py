"""Queries of pixel classification and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radiometry as rad
from ..operators import learning as ops
from ..sources import adapters as src
from ..sources import shared
from .registry import query

AT = ["scene_id", "row", "col"]
MB = src.BAND_RASTER_SQL
R = lambda c, n=6: F.round(c, n)
REGIONS = [ops.Region("low", 30, 50, 20, 38), ops.Region("middle", 48, 54, 30, 42), ops.Region("high", 52, 60, 36, 48)]
_HIT = lambda r: f"(x BETWEEN {r.x_min} AND {r.x_max} AND y BETWEEN {r.y_min} AND {r.y_max})"
_DB = f'WITH {MB}, d AS (SELECT scene_id, "row", col, CASE WHEN hh > 0 THEN 10 * log10(hh) END AS x, CASE WHEN hv > 0 THEN 10 * log10(hv) END AS y FROM mb)'
_FIRST = "CASE WHEN x IS NULL OR y IS NULL THEN 0 " + " ".join(f"WHEN {_HIT(r)} THEN {k + 1}" for k, r in enumerate(REGIONS)) + " ELSE 0 END"
_HITS = " + ".join(f"coalesce({_HIT(r)}, false)::INT" for r in REGIONS)
_LABEL = f"CASE WHEN {_HITS} = 0 THEN 255 WHEN {_HITS} > 1 THEN 254 ELSE ({_FIRST}) - 1 END"


def _db(spark, sf_dir):
    return src.band_raster(spark, sf_dir).select(*AT, rad.db(F.col("hh")).alias("x"), rad.db(F.col("hv")).alias("y"))


@query(f'{_DB} SELECT scene_id, "row", col, {_FIRST} AS class FROM d')
def classify_regions(spark, sf_dir):
    """Each pixel's first region in feature space."""
    return _db(spark, sf_dir).select(*AT, ops.classify(F.col("x"), F.col("y"), REGIONS).alias("class"))


@query(f'{_DB} SELECT scene_id, {_FIRST} AS class, count(*) AS n FROM d GROUP BY 1, 2')
def class_counts(spark, sf_dir):
    """Pixels of each class."""
    return _db(spark, sf_dir).groupBy("scene_id", ops.classify(F.col("x"), F.col("y"), REGIONS).alias("class")).agg(F.count("*").alias("n"))


@query(f"""{_DB}, l AS (SELECT *, {_LABEL} AS label, scene_id * 15625 + "row" * 125 + col AS id FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1337:' || id), id) AS k FROM l WHERE label < 254)
  SELECT id, label, round(x, 6) AS x, round(y, 6) AS y FROM r WHERE k <= 20000""")
def labelled_dataset(spark, sf_dir):
    """Labelled pixels, without ambiguous ones, at most 20,000 a class by a seeded order."""
    rows = _db(spark, sf_dir).select((F.col("scene_id") * 15625 + F.col("row") * 125 + F.col("col")).alias("id"), ops.label(F.col("x"), F.col("y"), REGIONS).alias("label"), R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))
    return ops.capped_sample(rows.where(F.col("label") < ops.AMBIGUOUS), "label", "id")


@query("""SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) <= CASE WHEN count(*) OVER (PARTITION BY label) >= 2 THEN greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.25 + 0.5)) ELSE 0 END AS held_out FROM embeddings""")
def stratified_split(spark, sf_dir):
    """A quarter of each class held out."""
    return ops.stratified_split(src.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("""SELECT CAST(feature AS INTEGER) AS feature, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END, 6) AS std FROM (SELECT unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""")
def standardizer(spark, sf_dir):
    """Mean and spread of each feature."""
    return ops.standardizer(src.table(spark, sf_dir, "embeddings"), "embedding").select("feature", R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"))


@query(f"""{_DB} SELECT scene_id, "row", col, CASE WHEN y IS NULL THEN 255 WHEN y < 30.5 THEN 1 WHEN x IS NULL THEN 255 WHEN x BETWEEN 45 AND 50 THEN 2 WHEN x >= 54 THEN 3 ELSE 0 END AS class FROM d""")
def heuristic_rules(spark, sf_dir):
    """Rules in order; a missing band that a rule needs makes the pixel invalid."""
    bands = {"x": F.col("x"), "y": F.col("y")}
    return _db(spark, sf_dir).select(*AT, ops.by_rules(bands, [("y", "<", 30.5, 1), ("x", "between", (45, 50), 2), ("x", ">=", 54, 3)]).alias("class"))


_W = [[0.8, -0.5, 0.1], [-0.2, 0.9, 0.0], [-0.6, -0.4, 0.2]]
_S = [f"{a} * (x - 50) / 4 + {b} * (y - 36) / 5 + {c}" for a, b, c in _W]


@query(f"""{_DB}, s AS (SELECT scene_id, "row", col, {_S[0]} AS a, {_S[1]} AS b, {_S[2]} AS c FROM d)
  SELECT scene_id, "row", col, CASE WHEN a IS NULL THEN 255 WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS class,
  round(CASE WHEN a IS NULL THEN 0.0 ELSE 1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) END, 6) AS confidence FROM s""")
def softmax_predict(spark, sf_dir):
    """A given logistic model on every pixel: class and confidence."""
    cls, p = ops.softmax_predict([F.col("x"), F.col("y")], [50.0, 36.0], [4.0, 5.0], _W)
    return _db(spark, sf_dir).select(*AT, cls.alias("class"), R(p).alias("confidence"))


_CONF = "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2"


@query(_CONF)
def confusion_matrix(spark, sf_dir):
    """Counts of truth and prediction."""
    return ops.confusion(src.table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""WITH m AS ({_CONF}), c AS (SELECT cls, coalesce(sum(n) FILTER (WHERE truth = cls AND predicted = cls), 0) AS tp, coalesce(sum(n) FILTER (WHERE truth = cls), 0) AS actual, coalesce(sum(n) FILTER (WHERE predicted = cls), 0) AS found
    FROM m, (SELECT truth AS cls FROM m UNION SELECT predicted FROM m) GROUP BY 1)
  SELECT cls, round(CASE WHEN found > 0 THEN tp / found ELSE 0.0 END, 6) AS "precision", round(CASE WHEN actual > 0 THEN tp / actual ELSE 0.0 END, 6) AS recall, round(CASE WHEN found + actual > 0 THEN 2 * tp / (found + actual) ELSE 0.0 END, 6) AS f1, round(CASE WHEN found + actual - tp > 0 THEN tp / (found + actual - tp) ELSE 0.0 END, 6) AS iou FROM c""")
def confusion_metrics(spark, sf_dir):
    """Precision, recall, F1 and IoU of each class."""
    found = ops.scores(ops.confusion(src.table(spark, sf_dir, "labels"), "quality", "toxic"))
    return found.select("cls", *(R(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "iou")))


@query(f"""{_DB} SELECT scene_id, bool_and(floor(x) = x AND x BETWEEN 0 AND 255) AND bool_or(x <> 0) AS raw_is_categorical, bool_and(CAST({_FIRST} AS DOUBLE) BETWEEN 0 AND 255) AND bool_or(({_FIRST}) <> 0) AS class_is_categorical FROM d GROUP BY 1""")
def looks_categorical(spark, sf_dir):
    """Whether a band's values are all small integers, not all zero."""
    looks = lambda c: F.bool_and((F.floor(c) == c) & c.between(0, 255)) & F.bool_or(c != 0)
    return _db(spark, sf_dir).groupBy("scene_id").agg(looks(F.col("x")).alias("raw_is_categorical"), looks(ops.classify(F.col("x"), F.col("y"), REGIONS)).alias("class_is_categorical"))


@query()
def logistic_fit(spark, sf_dir):
    """A logistic model of the regions, trained on three quarters of all labelled pixels and counted on the rest (a training loop is no SQL)."""
    rows = _db(spark, sf_dir).select((F.col("scene_id") * 15625 + F.col("row") * 125 + F.col("col")).alias("id"), ops.label(F.col("x"), F.col("y"), REGIONS).alias("label"), "x", "y")
    # the split, training, its statistics and the count read labelled pixels, not the bands they come from
    labelled = shared.staged(rows.where(F.col("label") < ops.AMBIGUOUS), "labelled")
    split = shared.staged(ops.stratified_split(labelled, "label", "id"), "split")
    model = ops.train_logistic(split.where("not held_out"), ["x", "y"], "label", len(REGIONS))
    cls, _ = ops.softmax_predict([F.col("x"), F.col("y")], model.mean, model.std, model.weights)
    return ops.confusion(split.where("held_out").withColumn("predicted", cls), "label", "predicted")
