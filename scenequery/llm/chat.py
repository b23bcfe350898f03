"""Chat formatting of reply trees, with DataFrame functions only.

A tree's rows point to their parents. Self-joins that double the distance (parent, grandparent, four up, ...) give every
row its depth and the score of its whole branch, then list the rows of each chosen root-to-leaf path: a path of n
rows takes about log2(n) joins, not n. Branches are ranked by score, and each chosen path becomes one conversation.

The template writes ``<|role:R|>text<|end|>`` for each turn. Inside roles and texts ``&``, ``<`` and ``>`` become
``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a control string and every text can be had back. The loss mask is a
list of (start, length) in code points of the formatted string: the texts of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ASSISTANT = "assistant"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows of the ``branches`` best root-to-leaf paths of each tree: (tree, leaf, branch, node, depth).

    ``nodes``: tree, node (unique within its tree), parent (null or absent from the tree: a root), score (null: 0).
    A branch scores the sum over its rows; ties go to the lower leaf. A tree may have several roots. Parents that form
    a circle are an error.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    step = nodes.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    first = common.staged(step, "reply-steps")
    rows, jumps = first.count(), []
    at_root, climbing = first.filter("up is null"), first.filter("up is not null")
    while climbing.count() > 0:
        if 2 ** len(jumps) > 2 * rows:
            raise ValueError(f"parents form a circle among {rows} rows")
        jumps.append(climbing.select("tree", "node", "up"))
        above = at_root.unionByName(climbing).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("total").alias("s"))
        step = climbing.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total")
        )
        step = common.staged(step, "reply-steps")
        at_root, climbing = at_root.unionByName(step.filter("up is null")), step.filter("up is not null")
    parents = first.filter("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = at_root.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node")))
    path = ranked.filter(F.col("branch") <= branches).select("tree", F.col("node").alias("leaf"), "branch", "node", "depth")
    for power in reversed(range(len(jumps))):
        jump = jumps[power].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        up = path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("depth") - 2**power).alias("depth"))
        path = common.staged(path.unionByName(up), "reply-paths")
    return path


def format_paths(turns: DataFrame) -> DataFrame:
    """One row per path: (path, formatted, loss). ``turns``: path, place, role, text; nulls count as empty.

    A path's turns are put together in one value, since its output is one string; only that string's size bounds the task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = turns.select("path", "place", (role == ASSISTANT).alias("learn"), F.concat(F.lit("<|role:"), escape(role), F.lit("|>")).alias("head"), escape(text).alias("body"))
    parts = parts.withColumn("part", F.concat("head", "body", F.lit("<|end|>")))
    before = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.length("head") + 1)
    whole = parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "part", "learn", "start", F.length("body").alias("length")))).alias("parts"))
    return whole.select(
        "path",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["start"].cast("int").alias("start"), p["length"].alias("length"))).alias("loss"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted string, in order: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|role:"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, "|>", 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, "|>", -2), "<|end|>", 1)).alias("text")))


def loss_texts(formatted: Column, loss: Column) -> Column:
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"], s["length"])))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted, stored and read back.

    The turns of a conversation are a chain of replies; rows with the same turn are ordered by role, then text.
    """
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text"))
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = talks.withColumn("node", F.row_number().over(in_order).cast("long"))
    nodes = common.staged(nodes.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)), "reply-nodes")
    paths = reply_paths(nodes.select(F.col("conv_id").alias("tree"), "node", "parent", F.lit(1.0).alias("score")))
    rows = nodes.select(F.col("conv_id").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(rows, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(F.struct("tree", "leaf").alias("path"), F.col("depth").alias("place"), "role", "text")
    stored = common.staged(format_paths(turns), "chat")
    read = stored.select(F.col("path.tree").alias("conv_id"), "formatted", parse_turns(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = f"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '{PROBE}'
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) AS BIGINT) AS formatted_chars
FROM talks GROUP BY conv_id
"""
