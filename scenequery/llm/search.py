"""Exact top-k search by BM25: inverted indexes of shards, block-max WAND pruning, merged with global statistics.

A shard holds the postings of up to ``SHARD_DOCS`` documents, by term. A task gathers documents for several shards first and deals
them by what they are like (their language, mostly), so that a shard's documents share frequent terms; within it they lie in
blocks of ``BLOCK_DOCS``. For each frequent term and block the index stores the most that it adds to a score there, up to the
term's idf. Queries that are alike are scored together: rare terms posting by posting, frequent ones by matrix products, where a
term is frequent for these queries and this shard if both together have it often enough to pay for a column. A block is a pivot
for a query if what its best document has from rare terms and the stored maxima of the frequent ones reach the k-th best score so
far; only pivots get the products. Scores of 32 bits, within their error, tell which documents may be among the best; those get
exact ones.

Before all shards are searched, the queries are tried on some of them, and the k-th best score found there is what all tasks start
from; a task raises it from shard to shard. With m of n shards tried, ``TRIED_TOGETHER`` in a task, both rounds together give some
k * (m / TRIED_TOGETHER + n / m) rows a query, fewest for the square root of TRIED_TOGETHER * n. What is left out cannot be among the
best, so the merged k are exact.

Queries come in blocks of about ``QUERIES_AT_ONCE``; only one such block is broadcast at a time. Each block of queries meets
all shards, so the work is that of queries times documents, less what the bounds leave out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .jaccard import word_hashes

K1, B = 1.2, 0.75
SHARD_DOCS = 4096
BLOCK_DOCS = 128
SHARDS_AT_ONCE = 4  # whose documents a task deals by what they are like
WORDS_AT_ONCE = 1 << 24  # or fewer, when documents are long
DENSE_SHARE = 1 / 48  # a term that more of a shard's documents have can be scored by matrix products
DENSE_PAIRS = 1 / 600  # it is where a larger share of all pairs of a query and a document have it both
QUERIES_AT_ONCE = 24_000
SCORED_AT_ONCE = 256
TRIED_TOGETHER = 3
TOP = 10
EVERY = 50
ERROR = 1e-4  # of sums in 32 bits, relative and absolute; measured ones are below 1e-5
NO_ID = 1 << 63  # stands for a null doc_id, after all others

_BINARY = {"lengths": "<u4", "vocab": "<u8", "starts": "<u4", "docs": "<u2", "tfs": "<u4", "block_starts": "<u4", "blocks": "<u2", "maxima": "<f4"}


def _word_count(text: str) -> int:
    """How many words of the contracts a text has, as ``word_hashes`` finds them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    return int(np.count_nonzero(inside[1:] > inside[:-1])) + int(inside[:1].sum())


def _impact(tf: np.ndarray, length: np.ndarray, mean_length: float) -> np.ndarray:
    """What a posting adds to a score, but for the term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1e-9)))


def _alike(texts: list[np.ndarray], seeds: int = 24, rounds: int = 4, sample: int = 1024, frequent: int = 512) -> np.ndarray:
    """An order of texts (hashes of their words) that puts those with the same frequent words next to each other, by length.

    Groups come from a sample by spherical k-means, in a chain from each group to the most similar one left. They only decide
    what is scored together, never what is found.
    """
    length = np.array([len(t) for t in texts])
    some = np.random.default_rng(len(texts)).permutation(len(texts))[:sample]
    vocab, count = np.unique(np.concatenate([np.unique(texts[i]) for i in some.tolist()]), return_counts=True)
    terms = np.sort(vocab[np.argsort(-count, kind="stable")[:frequent]])
    if not len(terms):
        return np.arange(len(texts))

    def places(own: list[np.ndarray]) -> np.ndarray:
        there, at = _matched(terms, np.concatenate(own))
        rows = np.zeros((len(own), len(terms)), np.float32)
        rows[np.repeat(np.arange(len(own)), [len(t) for t in own])[there], at] = 1
        return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))

    x = places([texts[i] for i in some.tolist()])
    centres = x[:seeds].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, 1)
        for c in range(len(centres)):
            total = x[near == c].sum(0)
            centres[c] = total / max(float(np.sqrt(total @ total)), 1e-9)
    alike, chain = centres @ centres.T, [0]
    while len(chain) < len(centres):
        alike[:, chain[-1]] = -1
        chain.append(int(np.argmax(alike[chain[-1]])))
    rank = np.empty(len(centres), np.int64)
    rank[chain] = np.arange(len(chain))
    own = np.concatenate([rank[np.argmax(places(texts[i : i + sample]) @ centres.T, 1)] for i in range(0, len(texts), sample)])
    return np.lexsort((length, own))


def _shard(ids: list, words: list[np.ndarray], mean_length: float) -> tuple[list, list[bytes]]:
    """doc_ids and the arrays of one shard, its documents ordered by their most frequent terms."""
    length = np.array([len(w) for w in words], np.int64)
    vocab, term = np.unique(np.concatenate(words), return_inverse=True)
    pairs, tf = np.unique(term.astype(np.int64) * len(words) + np.repeat(np.arange(len(words)), length), return_counts=True)
    of, doc = pairs // len(words), pairs % len(words)
    often = np.argsort(-np.bincount(of, minlength=len(vocab)), kind="stable")[:48]
    bit = np.zeros(len(vocab), np.int64)
    bit[often] = 1 << np.arange(47, 47 - len(often), -1)
    order = np.argsort(-np.bincount(doc, bit[of], len(words)), kind="stable")
    place = np.zeros(len(words), np.int64)
    place[order] = np.arange(len(words))
    length, doc = length[order], place[doc]
    by_place = np.lexsort((doc, of))
    doc, tf = doc[by_place], tf[by_place]
    ends = np.arange(len(vocab) + 1)
    starts = np.searchsorted(of, ends)
    own = np.flatnonzero(np.diff(starts)[of] > DENSE_SHARE * len(words))
    cell = of[own] * (len(words) // BLOCK_DOCS + 1) + doc[own] // BLOCK_DOCS
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    maxima = np.maximum.reduceat(_impact(tf[own].astype(np.float64), length[doc[own]], mean_length), first) if len(cell) else np.zeros(0)
    maxima = np.nextafter(maxima.astype(np.float32), np.float32(np.inf))
    first = own[first]
    parts = (length, vocab, starts, doc, tf, np.searchsorted(of[first], ends), doc[first] // BLOCK_DOCS, maxima)
    return [ids[i] for i in order.tolist()], [p.astype(t).tobytes() for p, t in zip(parts, _BINARY.values(), strict=True)]


def build_shards(docs: DataFrame, mean_length: float) -> DataFrame:
    """Index shards of all rows (doc_id, text), stored. A null text counts as empty; it is indexed and never found."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[np.ndarray] = []
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            order = _alike(words).tolist()
            for first in range(0, len(order), SHARD_DOCS):
                here = order[first : first + SHARD_DOCS]
                own, parts = _shard([ids[i] for i in here], [words[i] for i in here], mean_length)
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.list_(pa.int64())), *(pa.array([p], pa.binary()) for p in parts)], names=["doc_ids", *_BINARY])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                words.append(word_hashes(text))
                total += len(words[-1])
                if len(ids) >= SHARD_DOCS * SHARDS_AT_ONCE or (total >= WORDS_AT_ONCE and len(ids) >= SHARD_DOCS):
                    yield from out()
                    ids, words, total = [], [], 0
        if ids:
            yield from out()

    schema = "doc_ids array<long>, " + ", ".join(f"{c} binary" for c in _BINARY)
    # a row group a shard: Spark's reader takes thousands of rows of a group at once
    one = {"parquet.block.row.count.limit": "1"}
    return common.staged(docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(common.lean(build), schema), "index", one).withColumn("shard", F.xxhash64("doc_ids"))


def _matched(vocab: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``terms`` (sorted) that a shard has, and their places in its vocabulary."""
    if not len(vocab) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocab, terms), len(vocab) - 1)
    there = np.flatnonzero(vocab[at] == terms)
    return there, at[there]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Shard:
    """One shard, cut down to the asked terms."""

    def __init__(self, row: dict, terms: np.ndarray, idf: np.ndarray, mean_length: float):
        part = {c: np.frombuffer(row[c], t) for c, t in _BINARY.items()}
        length, n = part["lengths"].astype(np.int64), len(part["lengths"])
        self.ids = [NO_ID if d is None else d for d in row["doc_ids"]]
        self.n, self.blocks = n, -(-n // BLOCK_DOCS)
        asked, held = _matched(part["vocab"], terms)
        self.place = np.full(len(terms), -1, np.int64)
        self.place[asked] = np.arange(len(asked))
        idf = idf[asked]
        starts = part["starts"].astype(np.int64)
        self.start, self.size = starts[held], starts[held + 1] - starts[held]
        take = _ranges(self.start, self.size)
        self.start = np.cumsum(self.size) - self.size
        of = np.repeat(np.arange(len(asked)), self.size)
        docs = part["docs"][take]
        self.docs = docs.astype(np.int64)
        self.scores = idf[of] * _impact(part["tfs"][take].astype(np.float64), length[self.docs], mean_length)
        # terms of many documents, as matrices, with their most in each block
        dense = np.flatnonzero(self.size > DENSE_SHARE * n)
        self.column = np.full(len(asked), -1, np.int64)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), self.blocks * BLOCK_DOCS), np.float32)
        take = _ranges(self.start[dense], self.size[dense])
        self.matrix[np.repeat(np.arange(len(dense)), self.size[dense]), self.docs[take]] = self.scores[take]
        starts = part["block_starts"].astype(np.int64)
        first, size = starts[held[dense]], np.diff(starts)[held[dense]]
        take = _ranges(first, size)
        self.bounds = np.zeros((len(dense), self.blocks), np.float32)
        self.bounds[np.repeat(np.arange(len(dense)), size), part["blocks"][take]] = np.repeat(idf[dense], size) * part["maxima"][take] * (1 + ERROR)
        self.held = self.size[dense]
        # terms of each document, for exact scores
        order = np.argsort(docs, kind="stable")
        self.doc_start = np.searchsorted(docs[order], np.arange(n + 1)).tolist()
        self.doc_terms, self.doc_scores = of[order], self.scores[order]

    def search(self, queries: list[np.ndarray], best: list[list[tuple[float, int]]], least: np.ndarray, k: int) -> None:
        """Puts what this shard has into the k best of each query, as (-score, doc_id) in order, and raises ``least``, their last score."""
        for first in range(0, len(queries), SCORED_AT_ONCE):
            here = range(first, min(len(queries), first + SCORED_AT_ONCE))
            terms = [(t := self.place[queries[q]])[t >= 0] for q in here]
            self._search(terms, [best[q] for q in here], least[first : first + SCORED_AT_ONCE], k)

    def _search(self, terms: list[np.ndarray], best: list[list[tuple[float, int]]], least: np.ndarray, k: int) -> None:
        flat, query = np.concatenate(terms), np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        # frequent terms that pay for a column: shares of these queries and of the documents, multiplied
        column, width = self.column[flat], self.blocks * BLOCK_DOCS
        pays = np.flatnonzero(np.bincount(column[column >= 0], minlength=len(self.held)) * self.held > DENSE_PAIRS * len(terms) * self.n)
        place = np.full(len(self.held) + 1, -1, np.int64)  # the last one is that of rare terms, -1
        place[pays] = np.arange(len(pays))
        column = place[column]
        weights = np.zeros((len(terms), len(pays)), np.float32)
        weights[query[column >= 0], column[column >= 0]] = 1
        rare, rare_query = flat[column < 0], query[column < 0]
        size = self.size[rare]
        take = _ranges(self.start[rare], size)
        found = np.bincount(np.repeat(rare_query * width, size) + self.docs[take], self.scores[take], len(terms) * width).astype(np.float32).reshape(len(terms), self.blocks, BLOCK_DOCS)
        # the most that each query can score in each block
        bound = found.max(2) + weights @ self.bounds[pays]
        pivots = bound * (1 + ERROR) + ERROR >= np.maximum(least, ERROR)[:, None]
        enough = np.maximum(least * (1 - ERROR) - ERROR, 1e-12).astype(np.float32)
        hits = []
        for b in np.flatnonzero(pivots.any(0)).tolist():
            own = np.flatnonzero(pivots[:, b])
            score = found[own, b] + weights[own] @ self.matrix[pays, b * BLOCK_DOCS : (b + 1) * BLOCK_DOCS]
            q, d = np.nonzero(score >= enough[own, None])
            hits.append((own[q], d + b * BLOCK_DOCS, score[q, d]))
        if not hits:
            return
        of, doc, score = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(of, kind="stable")
        of, doc, score = of[order], doc[order], score[order]
        ends = np.searchsorted(of, np.arange(len(terms) + 1))
        asked = np.zeros(len(self.size), bool)
        for q in np.flatnonzero(np.diff(ends)).tolist():
            near, own_score = doc[ends[q] : ends[q + 1]], score[ends[q] : ends[q + 1]]
            if len(near) > k:
                kth = np.partition(own_score, len(near) - k)[len(near) - k]
                near = near[own_score >= kth * (1 - 2 * ERROR) - 2 * ERROR]
            asked[terms[q]] = True
            more = []
            for d in near.tolist():
                own = slice(self.doc_start[d], self.doc_start[d + 1])
                more.append((-round(float(self.doc_scores[own][asked[self.doc_terms[own]]].sum()), 9), self.ids[d]))
            asked[terms[q]] = False
            best[q][:] = sorted([*best[q], *more])[:k]
            if len(best[q]) == k:
                least[q] = max(least[q], -best[q][-1][0])


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each query: query_id, rank, doc_id, score. Ties go to the lower doc_id, a null one last.

    ``docs``: doc_id, text; other columns are not kept. ``queries``: query_id (a whole number that is not null, as doc_id),
    text. A query's distinct words count once each. Queries without words, or without a document that holds any of them,
    have no rows, as there are none for an empty table. Rows that repeat are documents, and queries, of their own; queries
    with the same id share their ranks. A text of any length is read whole.
    """
    spark = docs.sparkSession
    common.small_batches(spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([sum(map(_word_count, batch.column(0).to_pylist()))], pa.int64())], names=["n", "words"])

    whole = docs.select(common.text_or_empty().alias("text")).mapInArrow(common.lean(measure), "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n = whole["n"] or 0
    mean_length = (whole["words"] or 0) / max(1, n)
    shards = build_shards(docs, mean_length)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(word_hashes(t)).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["query_id", "terms"])

    asked = common.staged(queries.select("query_id", common.text_or_empty().alias("text")).mapInArrow(common.lean(terms_of), "query_id long, terms binary").filter(F.octet_length("terms") > 0), "queries")
    blocks, n_shards = max(1, -(-asked.count() // QUERIES_AT_ONCE)), shards.count()
    found = []
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        lists = [np.frombuffer(t, "<u8") for t in own.column("terms").to_pylist()]
        if lists:
            order = _alike(lists)
            lists, own = [lists[i] for i in order.tolist()], own.take(order)
            terms = np.unique(np.concatenate(lists))
            found.append(_search_block(spark, shards, n_shards, own.column("query_id").to_pylist(), [np.searchsorted(terms, x).astype(np.int32) for x in lists], terms, n, mean_length, k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionByName(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, shards: DataFrame, n_shards: int, ids: list[int], lists: list[np.ndarray], terms: np.ndarray, n: int, mean_length: float, k: int) -> DataFrame:
    shared, tried = spark.sparkContext.broadcast(terms), max(3, math.ceil((TRIED_TOGETHER * n_shards) ** 0.5))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        seen = np.zeros(len(terms), np.int64)
        for batch in batches:
            for vocab, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                there, at = _matched(np.frombuffer(vocab, "<u8"), terms)
                seen[there] += np.diff(np.frombuffer(starts, "<u4").astype(np.int64))[at]
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(seen[held], pa.int64())], names=["term", "df"])

    counted = shards.select("vocab", "starts").mapInArrow(common.lean(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(terms))
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    asked = spark.sparkContext.broadcast((ids, lists, np.log(1 + (n - df + 0.5) / (df + 0.5))))

    def searching(shards: DataFrame, least=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, (ids, lists, idf) = shared.value, asked.value
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            at_least = least.value.copy() if least else np.zeros(len(ids))
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Shard(batch.slice(i, 1).to_pylist()[0], terms, idf, mean_length)
                    shard.search(lists, best, at_least, k)
                    del shard
            rows = [(i, d, -s) for i, found in enumerate(best) for s, d in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([None if r[1] == NO_ID else r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query", "doc_id", "score"])

        return shards.mapInArrow(common.lean(run), "query long, doc_id long, score double")

    least = None
    if n_shards > tried:
        order = Window.partitionBy("query").orderBy(F.desc("score"))
        # spread evenly over the partitions, in a random order within each, as shards of one group differ in what they hold
        places = sorted((r["part"], r["shard"]) for r in shards.select(F.spark_partition_id().alias("part"), "shard").collect())
        some = shards.filter(F.col("shard").isin([places[(2 * i + 1) * n_shards // (2 * tried)][1] for i in range(tried)]))
        kth = searching(some.coalesce(math.ceil(tried / TRIED_TOGETHER))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query", "score").toArrow()
        known = np.zeros(len(ids))
        known[kth.column("query").to_numpy()] = kth.column("score").to_numpy()
        least = spark.sparkContext.broadcast(known)
    numbers = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int64()), "query_id": pa.array(ids, pa.int64())}))
    return common.staged(searching(shards, least), "found").join(F.broadcast(numbers), "query").select("query_id", "doc_id", "score")  # as many rows as QUERIES_AT_ONCE


def op5_block_max_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose doc_id is divisible by 50, as queries against all documents: query_id, rank, doc_id, score."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return search(docs, docs.filter(F.pmod("doc_id", F.lit(EVERY)) == 0).select(F.col("doc_id").alias("query_id"), "text"))
