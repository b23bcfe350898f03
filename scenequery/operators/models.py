"""Pixel models as data: a table of JSON manifests, checked by rules that give messages as columns, and many models run in one pass.

A manifest names its backend; rules and weights are parameters in it. Scoring joins pixels with the models that are asked for them
and carries out every backend as expressions over arrays, so a model more is a row more and no new plan. ``PREFIX`` stands before the
members that are no part of the common vocabulary for model metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, PREFIX = 2, "model"
MOST_MODELS = 10_000  # whose parameters go to every task
INVALID = 255
#: What a manifest may name.
TASKS = ("pixel-classifier", "segmentation", "detection", "regression", "enhancement", "embedding")
BACKENDS = ("builtin-heuristic", "builtin-classical", "onnx", "remote")
STRATEGIES, INTERACTIONS, TRANSFORMS, COMPARISONS = ("whole", "tiled"), ("none", "roi", "click"), ("none", "dB", "power"), ("<", "<=", ">", ">=", "between")


def parsed(text: Column, prefix: str = PREFIX) -> Column:
    """A manifest's members as a struct; null where the text is no JSON object. Numbers that matter stay texts until they are checked."""
    schema = f"""struct<`{prefix}`:string,id:string,`mlm:name`:string,`mlm:tasks`:array<string>,`{prefix}:backend`:string,`{prefix}:strategy`:string,`{prefix}:interaction`:string,
      `mlm:input`:array<struct<bands:array<string>,pre_processing_function:struct<format:string,expression:string>>>,
      `mlm:output`:array<struct<`classification:classes`:array<struct<value:int,name:string>>>>,
      `{prefix}:params`:struct<rules:array<struct<band:string,op:string,value:string,class:string>>,default:string,weights:array<string>,mean:array<string>,std:array<string>,modelBase64:string>,
      `mlm:artifacts`:array<struct<href:string>>,`{prefix}:tile`:struct<size:int,overlap:int>,`{prefix}:endpoint`:string,license:string>"""
    found = F.from_json(text, schema)
    return F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), found)


def validate(manifests: DataFrame, column: str = "manifest", prefix: str = PREFIX) -> DataFrame:
    """Adds m (the parsed struct with defaults beside it), errors, warnings and valid.

    Defaults: strategy whole, interaction none, transform none, tile 256 with an overlap of 16. A newer version, a transform of
    another format and a missing licence only warn; members that are not known are left alone.
    """
    m = manifests.withColumn("m", parsed(F.col(column), prefix))
    of = lambda name: F.col("m").getField(name)
    own = lambda name: of(f"{prefix}:{name}")
    params, version = own("params"), F.expr(f"try_cast(m.`{prefix}` AS double)")
    in_, out = F.get(of("mlm:input"), 0), F.get(of("mlm:output"), 0)
    pre, classes, bands = in_.getField("pre_processing_function"), out.getField("classification:classes"), in_.getField("bands")
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    tasks, backend = of("mlm:tasks"), own("backend")
    strategy, interaction = F.coalesce(own("strategy"), F.lit("whole")), F.coalesce(own("interaction"), F.lit("none"))
    foreign = pre.isNotNull() & ~pre.getField("format").eqNullSafe(f"{prefix}-transform")
    transform = F.when(pre.getField("format") == f"{prefix}-transform", F.coalesce(pre.getField("expression"), F.lit("none"))).otherwise("none")
    number = lambda c: c.try_cast("double")
    finite = lambda c: F.coalesce(F.abs(number(c)) < float("inf"), F.lit(False))
    whole = lambda c: F.coalesce(number(c) == F.floor(number(c)), F.lit(False))
    pair = lambda c: F.from_json(c, "array<string>")
    good = lambda r: F.when(r["op"] == "between", (F.size(pair(r["value"])) == 2) & F.forall(pair(r["value"]), finite)).otherwise(finite(r["value"]))
    rules, heuristic, classical = params.getField("rules"), backend == "builtin-heuristic", backend == "builtin-classical"
    each = lambda bad: F.coalesce(F.exists(rules, bad), F.lit(False))
    weights, mean, std = (params.getField(k) for k in ("weights", "mean", "std"))
    wanted, size = F.size(classes) * (F.size(bands) + 1), F.size(weights)
    broken = lambda c: F.coalesce(F.exists(c, lambda v: ~finite(v)), F.lit(False))
    first = lambda c: (F.array_position(F.transform(c, finite), False) - 1).cast("string")
    poisoned = F.coalesce(*(F.when(broken(c), F.concat(F.lit(f"params.{n}["), first(c), F.lit("] is not finite"))) for n, c in (("weights", weights), ("mean", mean), ("std", std))))
    tiled = (backend == "onnx") & (strategy == "tiled")
    say = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    there = F.col("m").isNotNull()
    errors = [
        say(~there, "not a JSON object"),
        say(there & ~F.coalesce(version >= VERSION, F.lit(False)), f"version {VERSION} is wanted"),
        say(there & blank(of("id")), "no id"),
        say(there & blank(of("mlm:name")), "no name"),
        say(there & none(tasks), "no tasks"),
        say(there & ~none(tasks) & F.exists(tasks, lambda t: ~t.isin(*TASKS)), F.concat(F.lit("unknown task "), F.get(F.filter(tasks, lambda t: ~t.isin(*TASKS)), 0))),
        say(there & ~F.coalesce(backend.isin(*BACKENDS), F.lit(False)), "unknown backend"),
        say(there & ~strategy.isin(*STRATEGIES), "unknown strategy"),
        say(there & ~interaction.isin(*INTERACTIONS), "unknown interaction"),
        say(there & none(of("mlm:input")), "no input"),
        say(there & ~none(of("mlm:input")) & none(bands), "no bands"),
        say(there & ~none(of("mlm:input")) & ~foreign & ~transform.isin(*TRANSFORMS), "unknown transform"),
        say(there & none(of("mlm:output")), "no output"),
        say(there & ~none(of("mlm:output")) & F.array_contains(tasks, "pixel-classifier") & ~F.coalesce(F.size(classes) >= 2, F.lit(False)), "a pixel classifier needs two classes"),
        say(heuristic & none(rules), "no rules"),
        say(heuristic & each(lambda r: ~whole(r["band"])), "a rule has no band"),
        say(heuristic & each(lambda r: ~F.coalesce(r["op"].isin(*COMPARISONS), F.lit(False))), "a rule has an unknown comparison"),
        say(heuristic & each(lambda r: ~F.coalesce(good(r), F.lit(False))), "a rule has no value"),
        say(heuristic & each(lambda r: ~whole(r["class"])), "a rule has no class"),
        say(classical & (weights.isNull() | mean.isNull() | std.isNull()), "weights, mean and std are wanted"),
        say(classical & (F.size(classes) >= 2) & (F.size(bands) >= 1) & (size >= 0) & (size != wanted), F.concat(size.cast("string"), F.lit(" weights, not "), wanted.cast("string"))),
        say(classical & poisoned.isNotNull(), poisoned),
        say((backend == "onnx") & ~F.coalesce(F.exists(of("mlm:artifacts"), lambda a: F.coalesce(a["href"], F.lit("")) != ""), F.lit(False)) & params.getField("modelBase64").isNull(), "no network"),
        say(tiled & ~F.coalesce(own("tile").getField("size") >= 32, F.lit(False)), "tiles of 32 pixels or more are wanted"),
        say((backend == "remote") & blank(own("endpoint")), "no endpoint"),
    ]
    warnings = [say(version > VERSION, "newer version"), say(foreign, "transform of another format"), say(there & blank(of("license")), "no licence")]
    told = m.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    tile = F.coalesce(own("tile"), F.struct(F.lit(256).alias("size"), F.lit(16).alias("overlap")))
    defaults = {"model_id": of("id"), "backend": backend, "strategy": strategy, "interaction": interaction, "transform": transform, "bands": F.coalesce(bands, F.array().cast("array<string>")), "classes": F.size(F.coalesce(classes, F.array().cast("array<struct<value:int,name:string>>"))), "tile_size": tile.getField("size"), "tile_overlap": tile.getField("overlap")}
    return told.withColumns(defaults | {"valid": F.size("errors") == 0})


def _parameters(checked: DataFrame, prefix: str) -> DataFrame:
    params = F.col("m").getField(f"{prefix}:params")
    numbers = lambda c: F.transform(c, lambda v: v.cast("double"))
    rule = lambda r: F.struct(r["band"].cast("double").cast("int").alias("band"), r["op"].alias("op"), F.when(r["op"] == "between", F.from_json(r["value"], "array<double>")).otherwise(F.array(r["value"].try_cast("double"))).alias("value"), r["class"].cast("double").cast("int").alias("class"))
    return checked.select("model_id", "backend", "transform", "bands", "classes", "errors", F.transform(params.getField("rules"), rule).alias("rules"), F.coalesce(params.getField("default").try_cast("int"), F.lit(0)).alias("default"), *(numbers(params.getField(k)).alias(k) for k in ("weights", "mean", "std")))


def run(pixels: DataFrame, keys: list[str], bands: list[str], requests: DataFrame, manifests: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(keys, model_id, class, confidence, problem) for every pixel and every model asked for its first key.

    ``requests``: the first of ``keys``, model_id, wanted (the names of the bands that it is given, in order). A model that is invalid,
    not there, of a backend that does not run here, or given another number of bands is one row a request with its problem
    and null keys beyond the first. Missing or non-finite values give class 255; rules end at the first that holds or whose band is
    missing. Of models that share an id one counts.
    """
    checked = _parameters(validate(manifests, prefix=prefix), prefix).dropDuplicates(["model_id"])
    models = F.broadcast(checked) if checked.count() <= MOST_MODELS else checked
    met = requests.join(models, "model_id", "left")
    problem = (
        F.when(F.col("backend").isNull() & F.col("errors").isNull(), F.lit("no such model"))
        .when(F.size("errors") > 0, F.concat(F.lit("invalid: "), F.array_join("errors", "; ")))
        .when(F.size("wanted") != F.size("bands"), F.concat(F.lit("needs "), F.size("bands").cast("string"), F.lit(" bands, got "), F.size("wanted").cast("string")))
        .when(~F.col("backend").isin("builtin-heuristic", "builtin-classical"), F.concat(F.lit("backend "), F.col("backend"), F.lit(" does not run here")))
    )
    met = met.withColumn("problem", problem)
    failed = met.filter("problem is not null").select(keys[0], *(F.lit(None).cast(pixels.schema[k].dataType).alias(k) for k in keys[1:]), "model_id", F.lit(None).cast("int").alias("class"), F.lit(None).cast("double").alias("confidence"), "problem")
    given = F.create_map(*(x for b in bands for x in (F.lit(b), F.col(b).cast("double"))))
    rows = pixels.join(met.filter("problem is null"), keys[0]).withColumn("_given", given)
    value = lambda name: F.try_element_at("_given", name)
    db = lambda v: F.when(v > 0, 10 * F.log10(v))
    shown = F.transform("wanted", lambda b: F.when(F.col("transform") == "dB", db(value(b))).otherwise(value(b)))
    rows = rows.withColumn("_x", F.transform(shown, lambda v: F.when(F.abs(v) < float("inf"), v)))
    x = lambda i: F.try_element_at("_x", i + 1)
    hit = lambda r: (
        F.when(r["op"] == "<", x(r["band"]) < r["value"][0]).when(r["op"] == "<=", x(r["band"]) <= r["value"][0]).when(r["op"] == ">", x(r["band"]) > r["value"][0]).when(r["op"] == ">=", x(r["band"]) >= r["value"][0]).otherwise(x(r["band"]).between(r["value"][0], r["value"][1]))
    )
    first = F.get(F.filter("rules", lambda r: x(r["band"]).isNull() | hit(r)), 0)
    by_rules = F.when(first.isNull(), F.col("default")).when(x(first.getField("band")).isNull(), INVALID).otherwise(first.getField("class"))
    f = F.size("_x")
    z = F.zip_with(F.zip_with("_x", "mean", lambda a, m: a - m), "std", lambda a, s: a / s)
    score = lambda c: F.aggregate(F.zip_with(F.slice("weights", c * (f + 1) + 1, f), F.col("_z"), lambda w, v: w * v), F.try_element_at("weights", (c + 1) * (f + 1)), lambda t, v: t + v)
    rows = rows.withColumn("_z", z).withColumn("_s", F.when(F.col("backend") == "builtin-classical", F.transform(F.sequence(F.lit(0), F.col("classes") - 1), score)))
    missing = F.exists("_x", lambda v: v.isNull())
    best = F.array_max("_s")
    by_scores = F.when(missing, INVALID).otherwise((F.array_position("_s", best) - 1).cast("int"))
    sure = F.when(~missing, 1 / F.aggregate("_s", F.lit(0.0), lambda t, v: t + F.exp(v - best)))
    linear = F.col("backend") == "builtin-classical"
    done = rows.select(*keys, "model_id", F.when(linear, by_scores).otherwise(by_rules).cast("int").alias("class"), F.when(linear, sure).alias("confidence"), F.lit(None).cast("string").alias("problem"))
    return done.unionByName(failed)
