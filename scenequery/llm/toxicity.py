"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are a text's distinct words and word beginnings. P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector
for all thresholds, which stay in order. The expected severity is the sum of P(grade > k).

Grades: 0 for rows labelled clean; rows labelled toxic are 1 or 2, up to or above the median number of different words
that carry a marker, since the labels themselves only say toxic or not; where they grade, ``fit_ordinal`` takes their grades.

The model is fitted on at most about ``MOST_LABELLED`` labelled rows, picked by a hash of doc_id. Its features are, of the words
and beginnings in these rows, those in at least ``LEAST_SEEN`` toxic ones whose odds of being toxic are above 3 and differ from 1
by ``LEAST_Z`` standard errors, the ``MOST_FEATURES`` most certain ones where there are more: a choice of the fit, like the sample.
Every document is scored over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MOST_LABELLED = 20_000
MOST_FEATURES = 4096
LEAST_SEEN = 3
LEAST_Z = 2.5
PRIOR = 0.1
STARTS = (3, 4, 5, 6, 7, 8)
REJECT = 0.5
CACHE_WORDS = 500_000

_WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a star)."""
    return [word, *(f"{word[:k]}*" for k in STARTS if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]


def fit_ordinal(rows: list[list[int]], grades: list[int], n_features: int, levels: int, steps: int = 1500, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the likelihood, with a normal prior on the weights, by full-batch Adam. ``rows``: indices of present features."""
    y, l2 = np.asarray(grades), prior / len(grades)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((j for r in rows for j in r), np.int64)
    share = np.array([(y > k).mean() for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    params = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, first_cut, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        cuts = first_cut + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(at, w[feature], len(rows))
        upper = np.where(y < levels - 1, sigmoid(cuts[np.minimum(y, levels - 2)] - score), 1.0)
        lower = np.where(y > 0, sigmoid(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = (d_up - d_low) / len(rows)  # of the negative log-likelihood
        g_cuts = np.zeros(levels - 1)
        np.add.at(g_cuts, np.minimum(y, levels - 2), -d_up * (y < levels - 1) / len(rows))
        np.add.at(g_cuts, np.maximum(y - 1, 0), d_low * (y > 0) / len(rows))
        grad = np.concatenate([np.bincount(feature, g_score[at], n_features) + l2 * w, [g_cuts.sum()], np.cumsum(g_cuts[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(params[n_features + 1 :])
    return params[:n_features], params[n_features] + np.concatenate([[0], np.cumsum(gaps)])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """Fit on labelled rows of ``docs``; None if they are not of both kinds. Rows without text or label are left out."""
    common.small_batches(docs.sparkSession)
    labels = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(1, labels.count())
    picked = labels.filter(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(n)) < most)  # about `most` rows, whatever n
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    rows = common.staged(rows.dropDuplicates(), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic > 0)].update({f for w in set(_WORDS(text.lower())) for f in word_features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (0, 1))], names=["feature", "clean", "toxic"])

    sides = {r["side"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("side")).count().collect()}
    if not sides.get(0) or not sides.get(1):
        return None
    counts = rows.mapInArrow(common.lean(count), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (sides[1] + 1)) - F.log((F.col("clean") + 0.5) / (sides[0] + 1))
    scored = counts.filter(F.col("toxic") >= LEAST_SEEN).withColumn("z", odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5)))
    features = [r["feature"] for r in scored.filter((F.col("z") > LEAST_Z) & (odds > math.log(3))).orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()]
    index = {f: i for i, f in enumerate(features)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hits = [], []
            for text in batch.column(0).to_pylist():
                marked = {w: got for w in set(_WORDS(text.lower())) if (got := [index[f] for f in word_features(w) if f in index])}
                found.append(sorted({i for got in marked.values() for i in got}))
                hits.append(len(marked))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(hits, pa.int32()), batch.column(1).cast(pa.int32())], names=["found", "hits", "toxic"])

    got = rows.mapInArrow(common.lean(keep), "found array<int>, hits int, toxic int").toArrow().to_pylist()  # about `most` rows
    got.sort(key=lambda r: (r["toxic"], r["hits"], r["found"]))
    median = float(np.median([r["hits"] for r in got if r["toxic"] > 0]))
    grades = [0 if r["toxic"] <= 0 else 1 + (r["hits"] > median) for r in got]
    weights, thresholds = fit_ordinal([r["found"] for r in got], grades, len(features), 3)
    return Model(dict(zip(features, weights.tolist(), strict=True)), thresholds.tolist())


def grade(docs: DataFrame, model: Model | None, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds grade, expected_severity (0 to 2), score (P(grade >= 1)) and toxic to every row (of whose columns ``keep`` stay, or all).

    The new names start with ``prefix``; a column that already has such a name is replaced.

    A null or empty text has no features and gets what the thresholds alone say. Without a model all rows are clean. Rows that
    repeat are graded each; an empty table gives an empty one; a text of any length is read whole.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = [prefix + c for c in ("grade", "expected_severity", "score", "toxic")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        cuts = np.asarray(model.thresholds if model else [40.0, 41.0])
        weights = model.weights if model else {}
        for batch in batches:
            totals = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                found: dict[str, float] = {}
                for w in set(_WORDS(text.lower())) if text else ():
                    marks = seen.get(w)
                    if marks is None:
                        if len(seen) > CACHE_WORDS:
                            seen.clear()
                        marks = seen[w] = {f: weights[f] for f in word_features(w) if f in weights} or ()
                    if marks:
                        found |= marks
                totals.append(math.fsum(found.values()))
            above = 1 / (1 + np.exp(np.clip(cuts[None, :] - np.asarray(totals)[:, None], -40, 40)))
            grades = (above >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, pa.array(grades, pa.int32()), pa.array(above.sum(1), pa.float64()), pa.array(above[:, 0], pa.float64()), pa.array(above[:, 0] >= REJECT, pa.bool_())],
                names=[*keep, *added],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema]
    return docs.mapInArrow(common.lean(score), ", ".join([*kept, *(f"`{c}` {t}" for c, t in zip(added, ("int", "double", "double", "boolean"), strict=True))]))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document graded: doc_id, toxic, grade, expected_severity, score."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade(docs, model, ["doc_id"]).select("doc_id", "toxic", "grade", "expected_severity", "score")
