"""Whole queries and pipeline stages against versions that share no code with them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenequery.llm import common, mixing, ring, search, toxicity
from test_text_operators import linked, low

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that the synthetic toxic documents hold; labels also call some documents toxic that hold none.
INSULTS = re.compile(r"\b(idiot|moron|stupid|trash|scum|loser|clown|pathetic|worthless)", re.IGNORECASE)


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF).collect()


def bm25(texts, queries, k):
    """query -> the k best (id, score), every document scored."""
    words = {i: [low(w) for w in WORD.findall(t or "")] for i, t in texts}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    tfs = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for tf in tfs.values() for t in tf)
    found = {}
    for q in queries:
        scored = []
        for i, tf in tfs.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for t in tfs[q] if t in tf)
            if s > 0:
                scored.append((-s, i))
        found[q] = sorted(scored)[: k + 20]
    return found


def test_op5_equals_brute_force(spark, docs):
    want = bm25([(d.doc_id, d.text) for d in docs], [d.doc_id for d in docs if d.doc_id % 50 == 0], 10)
    got = defaultdict(list)
    for r in search.op5_block_max_bm25(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    assert set(got) == {q for q, w in want.items() if w}
    for q, rows in got.items():
        assert [s for _, s in rows] == pytest.approx([-s for s, _ in want[q][:10]], abs=1e-8)
        by_id = {i: -s for s, i in want[q]}
        assert all(by_id[d] == pytest.approx(s, abs=1e-8) for d, s in rows)
        ties = [(-round(s, 9), d) for d, s in rows]
        assert ties == sorted(ties)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_shard_in_blocks_equals_brute_force(monkeypatch, seed):
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    monkeypatch.setattr(search, "SCORED_AT_ONCE", 7)
    rng = np.random.default_rng(seed)
    vocabulary = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    words = [vocabulary[np.minimum(399, rng.zipf(1.3, int(rng.integers(0, 80))))] for _ in range(300)]
    mean = float(np.mean([len(w) for w in words]))
    terms = np.unique(np.concatenate(words))
    df = np.array([sum(t in set(w.tolist()) for w in words) for t in terms.tolist()])
    idf = np.log(1 + (300 - df + 0.5) / (df + 0.5))
    ids, parts = search._shard([*range(299), None], words, mean)
    shard = search.Shard({"doc_ids": ids, **dict(zip(search._BINARY, parts, strict=True))}, terms, idf, mean)
    queries = [np.searchsorted(terms, np.unique(words[i])).astype(np.int32) for i in range(0, 300, 11)]
    best, least = [[] for _ in queries], np.zeros(len(queries))
    shard.search(queries, best, least, 5)
    pruned, kth = [[] for _ in queries], least.copy()
    shard.search(queries, pruned, kth, 5)  # again, with the last scores known
    for q, found, again in zip(queries, best, pruned, strict=True):
        asked = set(terms[q].tolist())
        want = []
        for i, w in enumerate(words):
            tf = Counter(w.tolist())
            s = sum(idf[np.searchsorted(terms, np.uint64(t))] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in tf.items() if t in asked)
            if s > 0:
                want.append((-round(s, 8), i if i < 299 else search.NO_ID))
        assert [d for _, d in found] == [d for _, d in sorted(want)[:5]]
        assert [s for s, _ in found] == pytest.approx([s for s, _ in sorted(want)[:5]], abs=1e-7)
        assert found == again


def test_op8_key_by_key(spark, docs):
    """A ring walked one key at a time."""
    at = {}
    for shard in range(8):
        for v in range(ring.VNODES):
            at.setdefault(int(hashlib.sha256(f"{shard}/{v}".encode()).hexdigest()[:8], 16) % ring.PLACES, shard)
    places = sorted(at)
    rows = common.documents(spark, SF).select("doc_id", "text", F.xxhash64(F.lit(ring.SEED), "doc_id").alias("h")).collect()

    def order(r):
        place = r.h % ring.PLACES
        arc = next((k for k, p in enumerate(places) if p >= place), 0)
        return ((r.h % 2**64) >> 12) % ring.STEPS, arc, r.h, r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())

    room = [len(rows) // 8 + (s < len(rows) % 8) for s in range(8)]
    used, want = Counter(), {}
    for r in sorted(rows, key=order):
        k = order(r)[1]
        while used[s := at[places[k % len(places)]]] == room[s]:
            k += 1
        want[r.doc_id] = (s, used[s])
        used[s] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in ring.op8_bounded_ring(spark, SF).collect()} == want


def test_a_hot_key_is_spread(spark):
    many = spark.range(4000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "cast(id AS string) AS text")
    rows = ring.assign(many, "doc_id", 8, ["text"]).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 4000 and set(sizes.values()) == {500}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(500)) for s in range(8))


def plain_mix(rows, hashes, seed=mixing.SEED):
    """taken of each row: targets by resharing, seats one at a time by highest quotients, blocks counted word by word."""
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    total = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2.0 * total[s] for s in over)
        open_ -= over

    def seats(votes, n, most):
        got = [0] * len(votes)
        for _ in range(min(n, sum(most))):
            i = max((i for i in range(len(votes)) if got[i] < most[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        return got

    shards = {s: max(1, math.ceil(total[s] / mixing.SHARD_WORDS)) for s in sources}
    cells = defaultdict(list)
    for r in rows:
        cells[sources.index(r.source), hashes[r.doc_id] % shards[r.source]].append(r)
    words = {c: sum(size[r.doc_id] for r in own) for c, own in cells.items()}
    blocks = {c: math.ceil(n / mixing.BLOCK_WORDS) for c, n in words.items()}
    most = [2 * sum(b for c, b in blocks.items() if c[0] == k) for k in range(len(sources))]
    quota = seats([target[s] for s in sources], round(sum(target.values()) / mixing.BLOCK_WORDS), most)
    taken = {}
    for k in range(len(sources)):
        own = sorted(c for c in cells if c[0] == k)
        for c, q in zip(own, seats([words[c] for c in own], quota[k], [2 * blocks[c] for c in own]), strict=True):
            n = blocks[c]
            h = int(hashlib.sha256(f"{seed}/{c}".encode()).hexdigest()[:12], 16)
            m = h % n or 1
            while math.gcd(m, n) > 1:
                m = m % n + 1
            times = [q // n + ((b * m + (h >> 20) % n) % n < q % n) for b in range(n)]
            place = 0
            for r in sorted(cells[c], key=lambda r: (hashes[r.doc_id], r.doc_id)):
                taken[r.doc_id] = sum(times[p // mixing.BLOCK_WORDS] for p in range(place, place + size[r.doc_id]))
                place += size[r.doc_id]
    return taken, target, size


def test_op9_block_by_block(spark, docs):
    hashes = {r.doc_id: r.h for r in common.documents(spark, SF).select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    taken, target, size = plain_mix(docs, hashes)
    source = {d.doc_id: d.source for d in docs}
    rows = mixing.op9_sainte_lague(spark, SF).collect()
    assert {r.doc_id: (r.size, r.taken) for r in rows} == {i: (size[i], t) for i, t in taken.items()}
    assert all(r.target == pytest.approx(target[source[r.doc_id]]) for r in rows)


def test_mix_is_the_same_in_any_partitioning_with_ties(spark):
    rows = [(k % 40, " ".join([f"w{k}"] * 30), "ab"[k % 2], k) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    runs = [sorted((r.other, r.taken) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_toxicity_on_rows_held_out(spark):
    """Fitted on three quarters of the labels, read on the rest, over documents whose insults the label can rest on."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    caught, toxic, false, clean = 0, 0, 0, 0
    for part in range(3):
        model = toxicity.fit(docs, labels.filter(F.pmod("doc_id", F.lit(3)) != part))
        rows = toxicity.grade(docs.select("doc_id", "text"), model, prefix="g_").join(labels.filter(F.pmod("doc_id", F.lit(3)) == part).select("doc_id", "toxic"), "doc_id").collect()
        toxic += sum(r.toxic and bool(INSULTS.search(r.text)) for r in rows)
        caught += sum(r.toxic and r.g_toxic and bool(INSULTS.search(r.text)) for r in rows)
        clean += sum(not r.toxic for r in rows)
        false += sum(not r.toxic and r.g_toxic for r in rows)
    assert toxic >= 30 and caught >= 0.9 * toxic and false <= 0.02 * clean


def test_grades_are_ordered_and_share_weights():
    """The probability of each grade by the formula, and a fit that finds graded marks again."""
    rng = np.random.default_rng(4)
    rows, grades = [], []
    for _ in range(3000):
        found = sorted(set(rng.integers(0, 6, 3).tolist()))
        score = sum((0.0, 0.5, 1.0, 2.0, 3.0, -1.0)[j] for j in found)
        noise = rng.logistic()
        rows.append(found)
        grades.append(int(score + noise > 1.5) + int(score + noise > 4.0))
    weights, cuts = toxicity.fit_ordinal(rows, grades, 6, 3)
    assert cuts[0] < cuts[1] and cuts[1] - cuts[0] == pytest.approx(2.5, abs=0.4)
    assert np.argsort(weights).tolist() == [5, 0, 1, 2, 3, 4] and weights[4] - weights[1] == pytest.approx(2.5, abs=0.5)


def test_run_chains_its_stages(spark, docs):
    """run() over all documents: ids, decoded texts and copies follow from the stages' own plain versions."""
    import public_tokenizers
    import tiktoken

    from scenequery.llm import bpe

    out = corpus_pipeline.run(spark, SF).collect()
    text = {d.doc_id: d.text for d in docs}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in out:
        ids = whole.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    times = Counter(r.doc_id for r in out)
    assert set(times.values()) <= {1, 2}
    kept, classes = set(times), linked([(d.doc_id, d.text) for d in docs])
    assert len({classes[i][1] for i in kept}) == len(kept)  # one document of each class of near duplicates
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    insulting = {i for i, t in labels.items() if t and INSULTS.search(text[i])}
    assert len(insulting & kept) <= 0.3 * len(insulting)  # learned from 87 labels, 11 of them toxic
    assert all(re.search(r"[^\W\d_]", text[i]) for i in kept)


def test_bpe_of_an_empty_table_and_of_long_texts(spark):
    import public_tokenizers

    from scenequery.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    schema = "doc_id string, text string, ids int, bytes int"
    assert bpe.encode(spark.createDataFrame([], schema), path, public_tokenizers.PATTERN).count() == 0
    assert bpe.round_trip(spark.createDataFrame([], schema), path, public_tokenizers.PATTERN).count() == 0
    texts = {"a": "x" * 300_000, "b": "word, " * 200_000, "c": None, None: "\n \n" * 1000}
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()] * 2, schema).repartition(3)
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted((str(r.doc_id), bytes(r.text_bytes)) for r in back) == sorted((str(k), (t or "").encode()) for k, t in texts.items() for _ in range(2))
    digests = {(r.doc_id, r.decoded_sha256) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    assert digests == {(k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in texts.items()}


def test_files_and_pictures_of_an_empty_table_and_of_long_texts(spark):
    import public_tokenizers

    from scenequery.llm import dac, webp

    path, schema = public_tokenizers.path("word_bpe_49k.json"), "doc_id long, text string, doc_tokens int, media int"
    none = spark.createDataFrame([], schema)
    assert dac.read_segments(dac.write_segments(none, path)).count() == 0 and webp.store_texts(none).count() == 0
    docs = spark.createDataFrame([(2, "ab " * 150_000, 0, 0), (1, "x" * 100_000, 0, 0)], schema)
    rows = dac.read_segments(dac.write_segments(docs, path)).orderBy("doc_id").collect()
    assert rows[0].start == 0 and rows[1].start == rows[0].n_tokens and rows[1].n_tokens == 150_001
