"""Reply trees, and the stages of the pipeline against plain versions of each on its own input."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenequery.llm import chat, common, jaccard, language, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_paths_of_trees(spark):
    rng = random.Random(2)
    rows, children = [], collections.defaultdict(list)
    for tree in range(12):
        for node in range(rng.randrange(1, 40)):
            parent = rng.randrange(node) if node and rng.random() < 0.95 else None
            rows.append((tree, node, parent, rng.choice([None, -1.0, 0.5, 2.0])))
            children[tree, parent].append(node)
    rows += [(50, k, k - 1 if k else 999, 1.0) for k in range(130)]
    score = {(t, n): s or 0.0 for t, n, _, s in rows}
    up = {(t, n): p if (t, p) in score else None for t, n, p, _ in rows}
    want = {}
    for t in {r[0] for r in rows}:
        parents = {up[k] for k in up if k[0] == t}
        paths = []
        for leaf in [n for k, n in score if k == t and n not in parents]:
            path = [leaf]
            while up[t, path[-1]] is not None:
                path.append(up[t, path[-1]])
            paths.append((-sum(score[t, n] for n in path), leaf, path[::-1]))
        for branch, (_, leaf, path) in enumerate(sorted(paths)[:2], 1):
            want[t, leaf] = (branch, path)
    got = collections.defaultdict(list)
    for r in chat.reply_paths(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), 2).collect():
        got[r.tree, r.leaf].append((r.depth, r.node, r.branch))
    assert {k: (v[0][2], [n for _, n, _ in sorted(v)]) for k, v in got.items()} == want
    assert all(sorted(d for d, _, _ in v) == list(range(1, len(v) + 1)) for v in got.values())


def test_circles_and_empty_trees(spark):
    schema = "tree long, node long, parent long, score double"
    with pytest.raises(ValueError):
        chat.reply_paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], schema))
    assert chat.reply_paths(spark.createDataFrame([], schema)).count() == 0


def test_template_gives_everything_back(spark):
    texts = ["<|end|>", "&lt;|role:x|>", "a & b > c < d", None, "", "line\nline", "<|role:assistant|>&amp;", "é日本😀"]
    rows = [(1, k, ["user", "assistant", None, "a>b"][k % 4], t) for k, t in enumerate(texts)]
    f = chat.format_paths(spark.createDataFrame(rows, "path long, place long, role string, text string"))
    r = f.select("formatted", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("learned")).first()
    assert [(t.role, t.text) for t in r.turns] == [(role or "", text or "") for _, _, role, text in rows]
    assert r.learned == [t or "" for _, _, role, t in rows if role == "assistant"]


def test_query_equals_sql_with_ties_and_nulls(spark, tmp_path):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 5, "assistant", "</s>"), (2, 5, "assistant", "</s>"), (3, 0, "system", ""), (None, 0, "user", "null id")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"t{k} &<>") for k in range(70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(chat.ORACLE)
    columns = [d[0] for d in found.description]
    assert sorted(map(str, (tuple(r) for r in chat.op7_reply_trees(spark, str(tmp_path)).select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "duplicates", "mixing", "tokens"]
    docs = common.documents(spark, SF).unionByName(spark.createDataFrame([(5000, None, None, None, 0), (5001, "!!! 12", "en", "src0", 6)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = common.staged(docs, "input")
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, docs, SF), name)
        if name != "tokens":
            assert out.columns == docs.columns and out.count() > 0
        if name == "toxicity":
            graded = toxicity.grade(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            assert rows_of(out) == rows_of(graded.filter("not toxic").select(*docs.columns))
        elif name == "language":
            kept = {r.doc_id for r in language.identify(docs, language.learn(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
            assert {r.doc_id for r in out.collect()} == kept and not kept & {5000, 5001}
        elif name == "duplicates":
            classes = jaccard.near_duplicates(docs).collect()
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in classes if r.doc_id == r.component_id} and out.count() == len({r.component_id for r in classes})
        elif name == "mixing":
            # whole documents: each taken / size times, rounded up or down, and a source's words to less than its longest one
            times, mixed = collections.Counter(r.doc_id for r in out.collect()), mixing.mix(docs).collect()
            assert set(times) <= {r.doc_id for r in mixed}
            for source in {r.source for r in mixed}:
                own = [r for r in mixed if r.source == source]
                assert all(r.taken // max(1, r["size"]) <= times[r.doc_id] <= -(-r.taken // max(1, r["size"])) for r in own)
                assert abs(sum(times[r.doc_id] * r["size"] - r.taken for r in own)) <= max(r["size"] for r in own)
        else:
            assert out.count() == docs.count() and out.columns[0] == "doc_id"
        docs = out


def test_stages_keep_extra_columns_and_empty_tables(spark):
    docs = common.documents(spark, SF).limit(40).withColumn("score", F.lit("s")).withColumn("size", F.lit("z")).withColumn("toxic", F.lit(1)).withColumn("key", F.lit(2))
    for rows in (common.staged(docs, "extra"), common.staged(docs.limit(0), "none")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF).columns == docs.columns, name
            assert stage(spark, rows, SF).count() <= 2 * rows.count()
