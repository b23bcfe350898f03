"""Queries of models as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as ops
from ..sources import adapters as src
from ..sources import shared
from .registry import query

#: A manifest a part: kind, limits, classes and what is missing follow from the part's own columns.
_TEXT = {
    "version": ("CASE WHEN p_size = 50 THEN 1 WHEN p_size = 49 THEN 3 ELSE 2 END"),
    "backend": "CASE WHEN p_type LIKE 'STANDARD%' THEN 'builtin-heuristic' WHEN p_type LIKE 'SMALL%' THEN 'builtin-classical' WHEN p_type LIKE 'MEDIUM%' THEN 'onnx' WHEN p_type LIKE 'LARGE%' THEN 'remote' WHEN p_type LIKE 'ECONOMY%' THEN 'builtin-heuristic' ELSE 'wasm' END",
    "rules": "CASE WHEN p_size % 3 = 0 THEN concat('{\"band\":0,\"op\":\"between\",\"value\":[', p_size, ',', p_size + 6, '],\"class\":1}') ELSE concat('{\"band\":', CASE WHEN p_size % 11 = 1 THEN '\"x\"' ELSE '0' END, ',\"op\":\"', CASE WHEN p_size % 7 = 1 THEN '!=' ELSE '<' END, '\",\"value\":', CASE WHEN p_size % 13 = 1 THEN 'null' ELSE CAST(p_size AS {s}) END, ',\"class\":', p_size % 2, '}') END",
    "weights": "concat('[', CAST(p_size AS {s}), ',-0.5,', CASE WHEN p_size % 5 = 1 THEN 'null' ELSE '0.25' END, CASE WHEN p_size % 4 = 1 THEN '' ELSE ',1.5' END, ']')",
}


def _manifest(s: str) -> str:
    t = {k: v.replace("{s}", s) for k, v in _TEXT.items()}
    return f"""CASE WHEN p_size % 23 = 0 THEN p_name ELSE concat('{{"model":', {t['version']}, ',"id":"m', p_partkey, '","mlm:name":"', CASE WHEN p_size % 17 = 0 THEN '' ELSE p_name END, '","mlm:tasks":[', CASE WHEN p_size % 19 = 0 THEN '"magic"' ELSE '"pixel-classifier"' END, '],"model:backend":"', {t['backend']},
      '","mlm:input":[{{"bands":["hh"],"pre_processing_function":{{"format":"', CASE WHEN p_size % 29 = 0 THEN 'own' ELSE 'model-transform' END, '","expression":"', CASE WHEN p_size % 31 = 0 THEN 'sqrt' ELSE 'dB' END, '"}}}}],"mlm:output":[{{"classification:classes":[{{"value":0,"name":"a"}}', CASE WHEN p_size % 8 = 0 THEN '' ELSE ',{{"value":1,"name":"b"}}' END, ']}}],"model:params":{{"rules":[', {t['rules']}, '],"weights":', {t['weights']}, ',"mean":[40],"std":[5]}}',
      CASE WHEN p_size % 2 = 0 THEN ',"mlm:artifacts":[{{"href":"x.onnx"}}]' ELSE '' END, CASE WHEN p_size % 6 = 0 THEN ',"model:endpoint":"https://models.example/1"' ELSE '' END, CASE WHEN p_size % 9 = 0 THEN '' ELSE ',"license":"CC0-1.0"' END, '}}') END"""


def _manifests(spark, sf_dir):
    return shared.spread(src.table(spark, sf_dir, "part")).select("p_partkey", F.expr(_manifest("STRING")).alias("manifest"))


_J = lambda path: f"json_extract_string(j, '$.{path}')"
_FINITE = lambda v: f"coalesce(try_cast({v} AS DOUBLE) IS NOT NULL, false)"


@query(f"""WITH p AS (SELECT p_partkey, {_manifest('VARCHAR')} AS t FROM part), q AS (SELECT p_partkey, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM p),
  r AS (SELECT *, {_J('"model:backend"')} AS backend, CAST(json_extract(j, '$."model:params".rules[0]') AS JSON) AS rule, json_array_length(j, '$."model:params".weights') AS nw, json_array_length(j, '$."mlm:output"[0]."classification:classes"') AS nc,
      {_J('"mlm:input"[0].pre_processing_function.format')} AS fmt, {_J('"mlm:input"[0].pre_processing_function.expression')} AS ex FROM q),
  e AS (SELECT p_partkey, j IS NULL AS lost, backend, list_filter([
      CASE WHEN j IS NULL THEN 'not a JSON object' END,
      CASE WHEN CAST({_J('model')} AS INTEGER) < 2 THEN 'version 2 is wanted' END,
      CASE WHEN {_J('"mlm:name"')} = '' THEN 'no name' END,
      CASE WHEN {_J('"mlm:tasks"[0]')} NOT IN ('pixel-classifier', 'segmentation', 'detection', 'regression', 'enhancement', 'embedding') THEN 'unknown task ' || {_J('"mlm:tasks"[0]')} END,
      CASE WHEN backend NOT IN ('builtin-heuristic', 'builtin-classical', 'onnx', 'remote') THEN 'unknown backend' END,
      CASE WHEN fmt = 'model-transform' AND ex NOT IN ('none', 'dB', 'power') THEN 'unknown transform' END,
      CASE WHEN {_J('"mlm:tasks"[0]')} = 'pixel-classifier' AND nc < 2 THEN 'a pixel classifier needs two classes' END,
      CASE WHEN backend = 'builtin-heuristic' AND json_type(rule, '$.band') NOT IN ('UBIGINT', 'BIGINT') THEN 'a rule has no band' END,
      CASE WHEN backend = 'builtin-heuristic' AND json_extract_string(rule, '$.op') NOT IN ('<', '<=', '>', '>=', 'between') THEN 'a rule has an unknown comparison' END,
      CASE WHEN backend = 'builtin-heuristic' AND json_type(rule, '$.value') = 'NULL' THEN 'a rule has no value' END,
      CASE WHEN backend = 'builtin-classical' AND nc >= 2 AND nw <> nc * 2 THEN nw || ' weights, not ' || nc * 2 END,
      CASE WHEN backend = 'builtin-classical' AND json_type(j, '$."model:params".weights[2]') = 'NULL' THEN 'params.weights[2] is not finite' END,
      CASE WHEN backend = 'onnx' AND {_J('"mlm:artifacts"[0].href')} IS NULL THEN 'no network' END,
      CASE WHEN backend = 'remote' AND {_J('"model:endpoint"')} IS NULL THEN 'no endpoint' END], lambda x: x IS NOT NULL) AS errors,
    list_filter([CASE WHEN CAST({_J('model')} AS INTEGER) > 2 THEN 'newer version' END, CASE WHEN fmt <> 'model-transform' THEN 'transform of another format' END, CASE WHEN j IS NOT NULL AND {_J('license')} IS NULL THEN 'no licence' END], lambda x: x IS NOT NULL) AS warnings,
    CASE WHEN fmt = 'model-transform' THEN ex ELSE 'none' END AS transform FROM r)
  SELECT p_partkey, backend, transform, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM e""")
def model_manifests(spark, sf_dir):
    """Model manifests, one a part, parsed and checked: errors, warnings and defaults as columns."""
    found = ops.validate(_manifests(spark, sf_dir))
    return found.select("p_partkey", "backend", "transform", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


_RUN = [(1, "builtin-heuristic", '"rules":[{"band":1,"op":"<","value":30.5,"class":1},{"band":0,"op":"between","value":[45,50],"class":2},{"band":0,"op":">=","value":54,"class":3}]'), (2, "builtin-classical", '"weights":[0.8,-0.5,0.1,-0.2,0.9,0.0,-0.6,-0.4,0.2],"mean":[50,36],"std":[4,5]'), (3, "onnx", '"modelBase64":"AA=="'), (4, "builtin-heuristic", '"rules":[]')]
_S = [f"{a} * (x - 50) / 4 + {b} * (y - 36) / 5 + {c}" for a, b, c in ((0.8, -0.5, 0.1), (-0.2, 0.9, 0.0), (-0.6, -0.4, 0.2))]


@query(f"""WITH {src.BAND_RASTER_SQL}, d AS (SELECT scene_id, "row", col, CASE WHEN hh > 0 THEN 10 * log10(hh) END AS x, CASE WHEN hv > 0 THEN 10 * log10(hv) END AS y FROM mb),
  s AS (SELECT *, {_S[0]} AS a, {_S[1]} AS b, {_S[2]} AS c FROM d), sc AS (SELECT DISTINCT scene_id FROM mb)
  SELECT scene_id, "row", col, 'run-1' AS model_id, CASE WHEN y IS NULL THEN 255 WHEN y < 30.5 THEN 1 WHEN x IS NULL THEN 255 WHEN x BETWEEN 45 AND 50 THEN 2 WHEN x >= 54 THEN 3 ELSE 0 END AS class, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS problem FROM d
  UNION ALL SELECT scene_id, "row", col, 'run-2', CASE WHEN a IS NULL THEN 255 WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END, round(1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6), NULL FROM s
  UNION ALL SELECT scene_id, NULL, NULL, id, NULL, NULL, p FROM sc, (VALUES ('run-3', 'backend onnx does not run here'), ('run-4', 'invalid: no rules'), ('run-5', 'no such model'), ('run-2b', 'needs 2 bands, got 1')) v(id, p)""")
def model_runs(spark, sf_dir):
    """Five models asked for every scene in one pass: rules, a linear model, and requests that cannot be met."""
    text = lambda k, backend, params: f'{{"model":2,"id":"run-{k}","mlm:name":"n","mlm:tasks":["pixel-classifier"],"model:backend":"{backend}","mlm:input":[{{"bands":["hh","hv"],"pre_processing_function":{{"format":"model-transform","expression":"dB"}}}}],"mlm:output":[{{"classification:classes":[{{"value":0,"name":"a"}},{{"value":1,"name":"b"}},{{"value":2,"name":"c"}}]}}],"model:params":{{{params}}},"license":"CC0-1.0"}}'
    manifests = [text(*m) for m in _RUN] + [text("2b", *_RUN[1][1:])]
    px = src.band_raster(spark, sf_dir)
    asked = F.explode(F.array(*(F.struct(F.lit(f"run-{k}").alias("model_id"), F.array(*map(F.lit, ("hh", "hv")[: 1 if k == "2b" else 2])).alias("wanted")) for k in (1, 2, 3, 4, 5, "2b"))))
    requests = px.select("scene_id").distinct().withColumn("a", asked).select("scene_id", "a.*")
    out = ops.run(px.select("scene_id", "row", "col", "hh", "hv"), ["scene_id", "row", "col"], ["hh", "hv"], requests, spark.createDataFrame([(m,) for m in manifests], "manifest string"))
    return out.withColumn("confidence", F.round("confidence", 6))
