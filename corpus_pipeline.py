"""A corpus from raw documents to token ids, in stages that each write their rows and read them again.

toxicity      documents graded toxic go
language      documents without letters, or of which less than half is in one language, go
duplicates    of each class of near duplicates the lowest doc_id stays
mixing        each document is taken as often as the mix takes its words: not at all, once or twice, rounded up or down such
              that the words of each shard of a source are met to less than its longest document
tokens        byte-level BPE ids of what is left, with digests of ids and of the text decoded from them

Rows with a null text count as clean in the first stage and go in the second. Rows that repeat a doc_id share its fate until the mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequery.llm import bpe, common, jaccard, language, mixing, toxicity

LEAST_LANGUAGE_SHARE = 0.5
CHUNK_CHARS = 1 << 20  # half of the operator's own: executors' heaps are large by the last stage
SMALL_ENOUGH_TO_SEND = 500_000  # ids of 8 bytes: 4 MB


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.grade(docs, model, prefix="_stage_").filter(~F.col("_stage_toxic")).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = language.identify(docs, language.learn(docs), prefix="_stage_")
    return labelled.filter((F.col("_stage_lang_pred") != language.NO_LANGUAGE) & (F.col("_stage_score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = common.staged(jaccard.near_duplicates(docs), "near-duplicates")
    others = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(F.broadcast(others) if others.count() <= SMALL_ENOUGH_TO_SEND else others, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, prefix="_stage_", copies=True)
    return mixed.filter("_stage_copies > 0").withColumn("_stage_time", F.explode(F.sequence(F.lit(1), F.col("_stage_copies")))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs, CHUNK_CHARS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Fitted models and tokenizers are not SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written as Parquet and read by the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        with common.noted() as paths:
            docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(spark, paths[:-1])  # what the stage wrote on its way
    return docs
