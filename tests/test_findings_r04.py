"""What the findings of round 4 asked for."""

from pyspark.sql import functions as F


def test_f3_all_labelled_pixels_are_counted(spark, monkeypatch):
    from scenequery.plans import learning as plans

    # a class of 28,000 pixels, two of 400
    corner = lambda low, middle, high: F.when(F.col("id") < 28_000, low).when(F.col("id") < 28_400, middle).otherwise(high) + F.rand(3)
    monkeypatch.setattr(plans, "_db", lambda session, folder: session.range(28_800).select(F.lit(0).alias("scene_id"), F.lit(0).alias("row"), F.col("id").alias("col"), corner(40, 51, 57).alias("x"), corner(22, 39, 46).alias("y")))
    found = plans.logistic_fit(spark, "").collect()
    counted = {k: sum(r.n for r in found if r.truth == k) for k in range(3)}
    assert counted == {0: 7000, 1: 100, 2: 100}


def test_f1_shards_hold_documents_that_are_alike(spark, monkeypatch):
    import random

    from scenequery.llm import search

    monkeypatch.setattr(search, "SHARD_DOCS", 32)
    rng = random.Random(4)
    rows = [(k, " ".join(f"{'xy'[k % 2]}{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(20, 80)))) for k in range(128)]
    shards = search.build_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 50.0).collect()
    assert sorted(d for r in shards for d in r.doc_ids) == list(range(128))
    assert [len({d % 2 for d in r.doc_ids}) for r in shards] == [1, 1, 1, 1]


def test_f1_word_counts(spark):
    from scenequery.llm import common, jaccard, search

    texts = ["", " ", "a", " a", "a ", "a b", "\ta\n\nb\x0bc\x0c d\r", "\x08\x0e\x1f", "\u00a0\u2003 \u00e4", "a" * 500 + "  b"]
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_count("t", F.lit(common.WORD))).collect()]
    assert [search._word_count(t) for t in texts] == want == [len(jaccard.word_hashes(t)) for t in texts]


def test_f1_each_shard_is_a_row_group(spark, monkeypatch):
    import pyarrow.parquet as pq

    from scenequery.llm import search

    monkeypatch.setattr(search, "SHARD_DOCS", 8)
    shards = search.build_shards(spark.createDataFrame([(k, f"w{k} w{k % 3}") for k in range(30)], "doc_id long, text string").coalesce(1), 2.0)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in shards.inputFiles()]
    assert sum(groups) == shards.count() == 4
