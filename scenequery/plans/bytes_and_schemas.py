"""Queries of samples in binary columns and of documents checked against schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import samples, schemas
from ..sources import adapters as src
from . import models
from .registry import query

#: 16 bytes of each document's whole text.
_HEX = "SELECT doc_id, upper(md5(coalesce(text, ''))) AS h FROM documents"
_U = lambda at, n: f"CAST(('0x' || substr(h, {at}, {n})) AS BIGINT)"
_I16 = lambda at: f"(CASE WHEN {_U(at, 4)} >= 32768 THEN {_U(at, 4)} - 65536 ELSE {_U(at, 4)} END)"


def _float_sql(b: str, e: int, f: int) -> str:
    top, bias = 2**e - 1, 2 ** (e - 1) - 1
    return f"""(CASE WHEN ({b} >> {e + f}) & 1 = 1 AND {b} & {2 ** (e + f) - 1} <> 0 THEN -1 ELSE 1 END * CASE WHEN ({b} >> {f}) & {top} = 0 THEN ({b} & {2**f - 1}) / {float(2**f)} * pow(2, {1 - bias}) WHEN ({b} >> {f}) & {top} = {top} THEN CASE WHEN {b} & {2**f - 1} <> 0 THEN CAST('nan' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END
      ELSE pow(2, (({b} >> {f}) & {top}) - {bias}) * (1 + ({b} & {2**f - 1}) / {float(2**f)}) END)"""


@query(f"""WITH d AS ({_HEX}), k AS (SELECT doc_id, i, {_U('4 * i + 1', 4)} AS big, {_U('4 * i + 3', 2)} * 256 + {_U('4 * i + 1', 2)} AS little FROM d, range(8) r(i))
  SELECT doc_id, CAST(i AS INTEGER) AS i, {_float_sql('little', 5, 10)} AS half_little, {_float_sql('big', 5, 10)} AS half_big, CAST(CASE WHEN little >= 32768 THEN little - 65536 ELSE little END AS DOUBLE) AS int16_little FROM k""")
def half_floats(spark, sf_dir):
    """Half-precision numbers and whole numbers of both byte orders in binary values."""
    data = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    kinds = {"half_little": ("float16", False), "half_big": ("float16", True), "int16_little": ("int16", False)}
    zipped = F.arrays_zip(*(samples.decoded(F.col("b"), *k).alias(n) for n, k in kinds.items()))
    rows = src.table(spark, sf_dir, "documents").select("doc_id", data.alias("b")).select("doc_id", F.posexplode(zipped).alias("i", "s"))
    return rows.select("doc_id", "i", *(F.col("s")[n].alias(n) for n in kinds))


@query(f"""WITH d AS ({_HEX}), p AS (SELECT doc_id, i, 0.5 * ({_I16('8 * i + 1')} * {_I16('8 * i + 1')} + {_I16('8 * i + 5')} * {_I16('8 * i + 5')}) AS int16, 2.0 * {_U('4 * i + 1', 2)} * {_U('4 * i + 1', 2)} AS amp8 FROM d, range(4) r(i))
  SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(int16 AS DOUBLE) AS int16, CAST(amp8 AS DOUBLE) AS amp8 FROM p""")
def complex_samples(spark, sf_dir):
    """Power of complex pixels, big-endian: pairs of 16 bits, and amplitudes of 8."""
    data = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    zipped = F.arrays_zip(samples.power(F.col("b"), "int16", 0.5).alias("int16"), F.slice(samples.power(F.col("b"), "amp8", 2.0), 1, 4).alias("amp8"))
    rows = src.table(spark, sf_dir, "documents").select("doc_id", data.alias("b")).select("doc_id", F.posexplode(zipped).alias("i", "s"))
    return rows.select("doc_id", "i", "s.int16", "s.amp8")


PROPS = {"props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 3, "maximum": 96, "anyOf": [{"type": "integer", "maximum": 49}, {"enum": [60, 70, 80]}, {"$ref": "./marks#/$defs/high"}]}}}, "marks": {"$defs": {"high": {"type": "integer", "minimum": 85}}}}


@query("""WITH p AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, json_exists(props, '$.k') AS has FROM events)
  SELECT event_id, unnest(list_filter([CASE WHEN NOT has THEN '$: k is missing' END, CASE WHEN k < 3 THEN '$.k: below 3' END, CASE WHEN k > 96 THEN '$.k: above 96' END,
    CASE WHEN k > 49 AND k NOT IN (60, 70, 80) AND k < 85 THEN '$.k: fits no branch' END], lambda x: x IS NOT NULL)) AS problem FROM p""")
def schema_problems(spark, sf_dir):
    """Event properties checked against a schema with branches and a reference: a row a problem."""
    return src.table(spark, sf_dir, "events").select("event_id", F.explode(schemas.problems(F.col("props"), "props", PROPS)).alias("problem"))


MANIFEST = {
    "manifest": {
        "type": "object",
        "required": ["model", "id", "license"],
        "properties": {
            "model": {"const": 2},
            "mlm:name": {"type": "string", "enum": ["cold widget", "large widget", "small widget", "blue rod", "large bolt"]},
            "mlm:tasks": {"type": "array", "minItems": 1, "items": {"enum": ["pixel-classifier", "detection"]}},
            "mlm:output": {"type": "array", "maxItems": 1, "items": {"type": "object", "properties": {"classification:classes": {"type": "array", "minItems": 2}}}},
            "model:params": {"$ref": "#/$defs/params"},
        },
        "$defs": {"params": {"type": "object", "properties": {"weights": {"type": "array", "items": {"type": "number", "maximum": 40}}, "rules": {"items": {"properties": {"band": {"type": "integer"}, "value": {"type": ["number", "array"]}}}}}}},
    }
}
_J = models._J


@query(f"""WITH p AS (SELECT p_partkey, {models._manifest('VARCHAR')} AS t FROM part), j AS (SELECT p_partkey, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM p),
  q AS (SELECT *, json_extract(j, '$."model:params".weights') AS w, json_extract(j, '$."model:params".rules[0]') AS r FROM j)
  SELECT p_partkey, unnest(list_filter(list_concat([
    CASE WHEN j IS NULL THEN '$: not JSON' END,
    CASE WHEN json_extract_string(j, '$.license') IS NULL AND j IS NOT NULL THEN '$: license is missing' END,
    CASE WHEN {_J('model')} <> '2' THEN '$.model: not 2' END,
    CASE WHEN {_J('"mlm:name"')} NOT IN ('cold widget', 'large widget', 'small widget', 'blue rod', 'large bolt') THEN '$.mlm:name: not one of ["cold widget", "large widget", "small widget", "blue rod", "large bolt"]' END,
    CASE WHEN {_J('"mlm:tasks"[0]')} NOT IN ('pixel-classifier', 'detection') THEN '$.mlm:tasks[0]: not one of ["pixel-classifier", "detection"]' END,
    CASE WHEN json_array_length(j, '$."mlm:output"[0]."classification:classes"') < 2 THEN '$.mlm:output[0].classification:classes: fewer than 2 items' END,
    CASE WHEN json_type(r, '$.band') = 'VARCHAR' THEN '$.model:params.rules[0].band: not of type integer' END,
    CASE WHEN json_type(r, '$.value') = 'NULL' THEN '$.model:params.rules[0].value: not of type number or array' END],
    list_transform(range(CAST(coalesce(json_array_length(w), 0) AS BIGINT)), lambda i: CASE WHEN json_type(w, '$[' || i || ']') = 'NULL' THEN '$.model:params.weights[' || i || ']: not of type number' WHEN CAST(json_extract_string(w, '$[' || i || ']') AS DOUBLE) > 40 THEN '$.model:params.weights[' || i || ']: above 40' END)), lambda x: x IS NOT NULL)) AS problem FROM q""")
def schema_manifests(spark, sf_dir):
    """Nested documents checked against a schema with references, enumerations and arrays: a row a problem."""
    return models._manifests(spark, sf_dir).select("p_partkey", F.explode(schemas.problems(F.col("manifest"), "manifest", MANIFEST)).alias("problem"))
