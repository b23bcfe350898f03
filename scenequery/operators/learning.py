"""Pixel classification: rules, regions, labelled sets, splits, scaling, logistic models, evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INVALID, AMBIGUOUS = 255, 254


@dataclass(frozen=True)
class Region:
    """A rectangle in feature space."""

    name: str
    x_min: float
    x_max: float
    y_min: float
    y_max: float

    def holds(self, x: Column, y: Column) -> Column:
        return x.between(self.x_min, self.x_max) & y.between(self.y_min, self.y_max)


def classify(x: Column, y: Column, regions: list[Region]) -> Column:
    """Number, from 1, of the first region that holds (x, y); 0 for none or missing values."""
    found = F.lit(0)
    for k in range(len(regions), 0, -1):
        found = F.when(regions[k - 1].holds(x, y), k).otherwise(found)
    return F.when(x.isNull() | y.isNull(), 0).otherwise(found)


def label(x: Column, y: Column, regions: list[Region]) -> Column:
    """Number, from 0, of the only region that holds (x, y); AMBIGUOUS in several, INVALID in none."""
    hits = sum((F.coalesce(r.holds(x, y), F.lit(False)).cast("int") for r in regions), F.lit(0))
    return F.when(hits == 0, INVALID).when(hits > 1, AMBIGUOUS).otherwise(classify(x, y, regions) - 1)


def by_rules(bands: dict[str, Column], rules: list[tuple[str, str, float | tuple, int]], default: int = 0) -> Column:
    """Class of the first rule (band, comparison, limit, class) that holds; INVALID if a band met before is missing."""
    out = F.lit(default)
    for band, how, limit, cls in reversed(rules):
        v = bands[band]
        hit = {"<": lambda: v < limit, "<=": lambda: v <= limit, ">": lambda: v > limit, ">=": lambda: v >= limit, "between": lambda: v.between(*limit)}[how]()  # noqa: B023
        out = F.when(v.isNull() | F.isnan(v), INVALID).when(hit, cls).otherwise(out)
    return out


def seeded_ranks(rows: DataFrame, cls: str, key: str, seed: str = "") -> DataFrame:
    """Adds _rank, from 1, and _total of each class, in the order of a hash of a key.

    Counts by the hash's first three digits say how many rows come before, so only rows that share them are ranked together: a
    class that has most rows is spread over 4096 groups.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("_part", F.substring("_hash", 1, 3))
    own = Window.partitionBy("_cls")
    counts = hashed.groupBy(F.col(cls).alias("_cls"), F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(own.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(own))
    met = hashed.join(counts, F.col(cls).eqNullSafe(F.col("_cls")) & (F.col("_part") == F.col("_at")))
    within = F.row_number().over(Window.partitionBy(cls, "_part").orderBy("_hash", key))
    return met.withColumn("_rank", within + F.col("_before")).drop("_hash", "_part", "_cls", "_at", "_n", "_before")


def capped_sample(rows: DataFrame, cls: str, key: str, most: int = 20_000, seed: int = 1337) -> DataFrame:
    """At most ``most`` rows of each class, by a seeded order of a key; the cap is the feature."""
    return seeded_ranks(rows, cls, key, f"{seed}:").where(F.col("_rank") <= most).drop("_rank", "_total")


def stratified_split(rows: DataFrame, cls: str, key: str, share: float = 0.25) -> DataFrame:
    """Adds held_out: of each class round(n * share) rows, one at least where it has two."""
    n = F.col("_total")
    held = F.when(n >= 2, F.greatest(F.lit(1), F.floor(n * share + 0.5))).otherwise(0)
    return seeded_ranks(rows, cls, key).withColumn("held_out", F.col("_rank") <= held).drop("_rank", "_total")


def standardizer(rows: DataFrame, features: str) -> DataFrame:
    """mean and std (population; 1 where it is nothing) of each place of an array column."""
    long = rows.select(F.posexplode(features).alias("feature", "x"))
    return long.groupBy("feature").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("_std")).select("feature", "mean", F.when(F.col("_std") > 1e-12, F.col("_std")).otherwise(1.0).alias("std"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts by truth and prediction; INVALID labels are left out."""
    return rows.where((F.col(truth) != INVALID) & (F.col(predicted) != INVALID)).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def scores(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1 and iou of each class of a confusion matrix."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.lit("t").alias("side")), F.struct(F.col("predicted").alias("cls"), F.lit("p").alias("side")))).alias("s"), "truth", "predicted", "n")
    at = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    c = sides.groupBy(F.col("s.cls").alias("cls")).agg(at((F.col("s.side") == "t") & (F.col("truth") == F.col("predicted"))).alias("tp"), at(F.col("s.side") == "t").alias("actual"), at(F.col("s.side") == "p").alias("found"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp, actual, found = F.col("tp"), F.col("actual"), F.col("found")
    return c.select("cls", ratio(tp, found).alias("precision"), ratio(tp, actual).alias("recall"), ratio(2 * tp, found + actual).alias("f1"), ratio(tp, found + actual - tp).alias("iou"))


def summary(rows: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """One row: n and accuracy over all rows, macro F1 and mean IoU over ``classes`` classes; INVALID predictions count as wrong in the accuracy only."""
    matrix = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    at = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    t, p = F.col("truth"), F.col("predicted")
    parts = [(at((t == k) & (p == k)), at((t == k) & (p != INVALID)), at(p == k)) for k in range(classes)]
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    mean = lambda f: sum((f(*x) for x in parts), F.lit(0.0)) / classes
    return matrix.agg(at(F.lit(True)).alias("n"), ratio(at(t == p), at(F.lit(True))).alias("accuracy"), mean(lambda tp, a, f: ratio(2 * tp, a + f)).alias("macro_f1"), mean(lambda tp, a, f: ratio(tp, a + f - tp)).alias("mean_iou"))


def assert_finite(**parameters) -> None:
    """An error that names the first model parameter that is not finite."""
    for name, values in parameters.items():
        flat = [x for row in values for x in (row if isinstance(row, (list, tuple)) else [row])]
        for i, x in enumerate(flat):
            if not math.isfinite(x):
                raise ValueError(f"{name}[{i}] of the model is {x}")


def softmax_predict(features: list[Column], mean: list[float], std: list[float], weights: list[list[float]]) -> tuple[Column, Column]:
    """Class (the first of the best) and its probability; weights are a row a class, bias last. INVALID for missing features."""
    assert_finite(weights=weights, mean=mean, std=std)
    z = [(x - m) / s for x, m, s in zip(features, mean, std, strict=True)]
    s = [sum((w * x for w, x in zip(row[:-1], z, strict=True)), F.lit(row[-1])) for row in weights]
    best = F.greatest(*s)
    cls = F.lit(len(s) - 1)
    for k in range(len(s) - 2, -1, -1):
        cls = F.when(s[k] == best, k).otherwise(cls)
    missing = sum((x.isNull().cast("int") for x in features), F.lit(0)) > 0
    return F.when(missing, INVALID).otherwise(cls), F.when(missing, 0.0).otherwise(1 / sum((F.exp(x - best) for x in s), F.lit(0.0)))


@dataclass(frozen=True)
class Logistic:
    """weights: a row a class, bias last; mean and std of the features; the loss of each epoch."""

    weights: list[list[float]]
    mean: list[float]
    std: list[float]
    history: list[float]


def require_classes(rows: DataFrame, cls: str, names: list[str]) -> dict[int, int]:
    """Rows of each class, numbered as in ``names``; an error with fewer than two classes, or one that names those without rows."""
    if len(names) < 2:
        raise ValueError("two classes or more are wanted")
    counts = {r[cls]: r["count"] for r in rows.filter(F.col(cls).between(0, len(names) - 1)).groupBy(cls).count().collect()}
    empty = [n for k, n in enumerate(names) if not counts.get(k)]
    if empty:
        raise ValueError(f"no rows of {', '.join(empty)}")
    return {k: counts[k] for k in range(len(names))}


def train_logistic(rows: DataFrame, features: list[str], cls: str, classes: int, epochs: int = 60, batches: int = 1, rate: float = 0.3, momentum: float = 0.9, l2: float = 1e-4, seed: int = 1337, tolerance: float = 0.0) -> Logistic:
    """Multinomial logistic regression by gradient steps with momentum on standardized features; biases do not decay.

    Rows are packed into blocks of numbers once. A step is one pass over a batch: each task adds up loss and gradient of its
    rows, and these few numbers a task meet on the driver. Rows are dealt to ``batches`` batches an epoch by a seeded hash of their content, so reruns agree. Training ends early once an
    epoch lowers the loss by less than ``tolerance`` of it. Rows whose class is no class are left out; a feature that is missing or not
    finite is an error, as are weights that diverge.
    """
    if classes < 2 or not features:
        raise ValueError("two classes or more, and features, are wanted")
    known = rows.filter(F.col(cls).between(0, classes - 1)).select(F.col(cls).cast("int").alias("_cls"), *(F.col(f).cast("double").alias(f) for f in features))
    bad = lambda f: F.coalesce(F.abs(F.col(f)) == float("inf"), F.lit(True)) | F.isnan(f)
    told = known.agg(F.count("*").alias("n"), *(x for f in features for x in (F.count_if(bad(f)).alias(f"bad_{f}"), F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"std_{f}")))).collect()[0]
    if not told["n"]:
        raise ValueError("no rows to learn from")
    for f in features:
        if told[f"bad_{f}"]:
            raise ValueError(f"{told[f'bad_{f}']} values of {f} are missing or not finite: leave such rows out first")
    mean = [told[f"mean_{f}"] for f in features]
    std = [told[f"std_{f}"] if told[f"std_{f}"] > 1e-12 else 1.0 for f in features]
    scaled = known.select("_cls", F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(batches)).cast("int").alias("_batch"), *(((F.col(f) - m) / s).alias(f"_x{k}") for k, (f, m, s) in enumerate(zip(features, mean, std, strict=True))))

    def packed(parts):
        for part in parts:
            y, of = part.column(0).to_numpy(), part.column(1).to_numpy()
            x = np.column_stack([*(c.to_numpy() for c in part.columns[2:]), np.ones(len(y))])
            for batch in np.unique(of):
                own = of == batch
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int32()), pa.array([y[own].tobytes()], pa.binary()), pa.array([x[own].tobytes()], pa.binary())], names=["batch", "y", "x"])

    blocks = scaled.mapInArrow(packed, "batch int, y binary, x binary").persist()  # every pass reads them
    w, v = np.zeros((classes, len(features) + 1)), np.zeros((classes, len(features) + 1))
    history: list[float] = []

    def gradient(at: np.ndarray, batch: int) -> tuple[float, int, np.ndarray]:
        def sums(parts):
            loss, n, g = 0.0, 0, np.zeros_like(at)
            for y, x in ((y.as_buffer(), x.as_buffer()) for part in parts for y, x in zip(part.column(0), part.column(1), strict=True)):
                y = np.frombuffer(y, np.int32)
                x = np.frombuffer(x).reshape(len(y), -1)
                s = x @ at.T
                p = np.exp(s - s.max(1, keepdims=True, initial=-np.inf))
                p /= p.sum(1, keepdims=True)
                loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum())
                p[np.arange(len(y)), y] -= 1
                n, g = n + len(y), g + p.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([g.tobytes()], pa.binary())], names=["loss", "n", "g"])

        found = blocks.filter(F.col("batch") == batch).select("y", "x").mapInArrow(sums, "loss double, n long, g binary").collect()
        return sum(r["loss"] for r in found), sum(r["n"] for r in found), sum((np.frombuffer(r["g"]).reshape(at.shape) for r in found), np.zeros_like(at))

    try:
        for _ in range(epochs):
            total = 0.0
            for batch in range(batches):
                loss, n, g = gradient(w, batch)
                if n:
                    g[:, :-1] += l2 * n * w[:, :-1]
                    v = momentum * v - rate / n * g
                    w = w + v
                total += loss
            history.append(total / told["n"])
            if len(history) > 1 and tolerance and history[-2] - history[-1] < tolerance * history[-2]:
                break
    finally:
        blocks.unpersist()
    if not np.isfinite(w).all():
        raise ValueError("weights diverged: take a lower rate")
    return Logistic(w.tolist(), mean, std, history)
