"""Operators on documents against plain versions, with nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from scenequery.llm import bpe, common, dac, jaccard, language, mixing, ring, search, toxicity

WORD = re.compile(common.WORD)
ODD = [None, "", "   \n", "a", "The cat's 2nd  line\n\n end ", "é日本 ß İ ½ x́", "x" * 5000, "w " * 3000, "same words here again now", "same words here again now"]
EXTRA = "doc_id long, text string, source string, size long, score string, grade string, `key` int, `row` int, shard string, _h int"


def odd_docs(spark):
    rows = [(i, t, [None, "a", "b"][i % 3], i, "s", "g", i, i, "x", i) for i, t in enumerate(ODD)] + [(0, None, "a", 1, "s", "g", 1, 1, "x", 1), (None, "null id", "a", 1, "s", "g", 1, 1, "x", 1)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def low(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def grams(text):
    w = [low(x) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(rows):
    """doc_id -> (shingles, smallest doc_id reached), all pairs compared."""
    sets = [(i, grams(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(a), top(i)) for i, a in sets}


def test_jaccard_equals_all_pairs(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 30, 120]))] for _ in range(25)]
    rows = []
    for k in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(300)}"
        rows.append((k, " ".join(w)))
    rows += [(k + 1000, t) for k, t in enumerate(ODD)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)


def test_jaccard_large_block_is_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words[:k], f"y{k}", *words[k + 1 :]])) for k in range(100)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_signature_tree_finds_all_links():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(12)]
    sets = []
    for k in range(150):
        b = base[k % 12]
        kept = b[rng.random(len(b)) > rng.choice([0.02, 0.1, 0.2])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)])))
    links = jaccard.link_block(sets, np.arange(150))
    up = list(range(150))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links:
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        assert 100 * len(a & b) >= 75 * len(a | b)
        up[top(i)] = top(j)
    for i in range(150):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 75 * len(a | b):
                assert top(i) == top(j)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.key: r["class"] for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_dac_levels_and_random_access():
    ids = np.concatenate([np.arange(300), [65535, 65536, 2**32 - 1, 0], np.random.default_rng(2).integers(0, 70000, 3000)]).astype(np.uint32)
    codes = dac.Codes(dac.pack(ids))
    assert codes.all().tolist() == ids.tolist()
    assert [codes[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
    with pytest.raises(IndexError):
        codes[len(ids)]
    assert len(dac.Codes(dac.pack(np.zeros(0)))) == 0


def test_dac_files_hold_what_the_tokenizer_says(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 500)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = odd_docs(spark)
    got = dac.read_segments(dac.write_segments(docs, public_tokenizers.path("word_bpe_49k.json"))).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, row in zip(got, rows, strict=True):
        ids = [*whole.encode(row.text or "", add_special_tokens=False).ids, dac.END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_word_tokenizer_on_random_strings():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own, rng = Tokenizer.from_file(path), dac.WordTokenizer(path), random.Random(1)
    alphabet = [*"abcXYZ 'stremd0123 \t\né́ÉßİıΣ中\x1c\x85.,!<|", "<|endoftext|>", "'ll", "the "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30)))
        assert np.frombuffer(own.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_bpe_equals_tiktoken(spark, frequent):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = odd_docs(spark)
    got = bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN, frequent), path).collect()
    want = []
    for r in docs.collect():
        ids = whole.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    texts = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted(bytes(r.text_bytes) for r in texts) == sorted((r.text or "").encode() for r in docs.collect())


def test_bounded_ring(spark):
    docs = odd_docs(spark)
    many = spark.range(1003).selectExpr("id as doc_id", "'t' as text")
    rows = ring.assign(many, "doc_id", 8, ["text"]).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes.values()) == {125, 126} and len(sizes) == 8
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    again = {r.doc_id: r.shard for r in ring.assign(many.repartition(7), "doc_id", 8, ["text"]).collect()}
    grown = {r.doc_id: r.shard for r in ring.assign(many, "doc_id", 9, ["text"]).collect()}
    assert again == {r.doc_id: r.shard for r in rows}
    assert sum(again[d] != grown[d] for d in grown) < 0.3 * len(grown)
    odd = ring.assign(docs, "doc_id", 3, ["text"])
    assert odd.count() == docs.count() and odd.columns.count("shard") == 1
    assert ring.assign(docs.limit(0), "doc_id", 3, []).count() == 0
    assert ring.overflow([(0, 0), (5, 1)], {(0, 0): 5, (1, 0): 1}, [3, 3]) == [(0, 0, 0, 0, 0), (0, 0, 3, 1, 0), (1, 0, 0, 1, 2)]


def test_sainte_lague_is_highest_quotients():
    rng = random.Random(3)
    for _ in range(40):
        votes = [rng.choice([0, rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 9))]
        most = [rng.randrange(1, 40) for _ in votes]
        seats = rng.randrange(0, 60)
        got = mixing.sainte_lague(votes, seats, most)
        plain = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] and plain[i] < most[i]]
            if not open_:
                break
            plain[max(open_, key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))] += 1
        assert got == plain


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 400))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(600)]
    rows += [(k + 1000, t, "b") for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs.repartition(5)).collect()
    text = {r[0]: r[1] for r in rows}
    by = defaultdict(lambda: [0, 0, None])
    for r in got:
        assert r["size"] == len(WORD.findall(text[r.doc_id] or "")) and 0 <= r.taken <= 2 * r["size"]
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = (r.source_size, r.target)
    for size, taken, (source_size, target) in by.values():
        assert size == source_size and target <= 2 * size + 1e-9 and abs(taken - target) <= 0.02 * target + 130
    assert sum(x[2][1] for x in by.values()) == pytest.approx(1.5 * sum(x[0] for x in by.values()))
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(2)).collect()} == {(r.doc_id, r.taken) for r in got}
    odd = mixing.mix(odd_docs(spark))
    assert odd.count() == len(ODD) + 2 and odd.columns.count("size") == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_targets_reshare_the_excess():
    assert mixing.mix_targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.mix_targets([10, 1000, 10], [3, 1, 2]) == pytest.approx([20, 1490, 20])
    assert mixing.mix_targets([], []) == [] and mixing.mix_targets([0, 5], [3, 1]) == [0, 7.5]


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(6)
    plain = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        bad = k % 5 == 0
        if bad:
            words[3:3] = [rng.choice(["vile", "rotten", f"grimpo{rng.choice('abcdefgh')}{rng.choice('xyz')}"]) for _ in range(rng.choice([1, 2, 6]))]
        docs.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(bad)))
    docs += [(k + 1000, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.grade(df, model).collect()}
    unseen = [k for k in range(600) if k % 2]
    right = sum(got[k].toxic == (k % 5 == 0) for k in unseen) / len(unseen)
    assert right > 0.97 and not any(got[k].toxic for k in range(1000, 1010))
    assert all(0 <= r.expected_severity <= 2 and (r.grade >= 1) == r.toxic for r in got.values())
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]


def test_toxicity_without_both_labels(spark):
    docs = odd_docs(spark)
    assert toxicity.fit(docs, spark.createDataFrame([(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")) is None
    got = toxicity.grade(docs, None)
    assert got.count() == docs.count() and not any(r.toxic for r in got.collect()) and got.columns.count("grade") == 1
    assert toxicity.grade(docs.limit(0), None).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(500):
        r = [j for j in range(4) if rng.random() < 0.5]
        rows.append(r)
        grades.append(0 if not r else 1 if len(r) < 3 else 2)
    w, cuts = toxicity.fit_ordinal(rows, grades, 4, 3)
    assert (w > 0).all() and cuts[0] < cuts[1]
    score = np.array([w[r].sum() for r in rows])
    assert np.mean((score[:, None] > cuts[None, :]).sum(1) == grades) > 0.97


def test_language_of_mixed_and_odd_texts(spark):
    rng = random.Random(7)
    words = {"en": ["the", "thing", "whether", "with", "those"], "fr": ["où", "être", "beaucoup", "quelque", "naïve"], "ru": ["привет", "что", "это", "который"]}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, make(lang, 40), lang) for k in range(240) for lang in (["en", "fr", "ru"][k % 3],)]
    rows += [(1000, make("en", 60) + " " + make("fr", 20), None), (1001, "123 !?", "en"), (1002, None, "fr"), (1003, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, language.learn(docs), spans=True).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:240])
    assert got[1000].lang_pred == "en" and [(s.first, s.words, s.lang) for s in got[1000].spans] == [(0, 60, "en"), (60, 20, "fr")]
    assert {got[k].lang_pred for k in (1001, 1002, 1003)} == {"und"} and all(got[k].score == 0 for k in (1001, 1002, 1003))
    assert language.script_of("ж") == "Cyrillic" and language.script_of("中") == "Han"
    odd = language.identify(odd_docs(spark), None)
    assert {r.lang_pred for r in odd.collect()} == {"und"} and odd.columns.count("score") == 1
    assert language.learn(docs.limit(0)) is None


def test_viterbi_equals_plain_dynamic_programming():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(9, 3)) * 3
    lengths = np.array([0, 1, 7, 30, 7])
    word = rng.integers(0, 9, lengths.sum()).astype(np.int32)
    got, at = language.viterbi(scores, word, lengths, 2.0), 0
    for n in lengths:
        s = scores[word[at : at + n]]
        value = lambda path: sum(s[t, p] for t, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = np.zeros(3)
        for t in range(n):
            best = s[t] + (np.maximum(best, best.max() - 2.0) if t else 0)
        if n:
            assert value(got[at : at + n].tolist()) == pytest.approx(best.max())
        at += n


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "BLOCK_DOCS", 8)
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 5)
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 60)))) for k in range(300)]
    rows += [(k + 1000, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(k, t) for k, t in rows if k % 25 == 0 or k >= 1000] + [(5000, "nowhere")], "query_id long, text string")
    got = defaultdict(list)
    for r in search.search(docs, queries, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    words = {i: [low(w) for w in WORD.findall(t or "")] for i, t in rows}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    for q, text in [(r.query_id, r.text) for r in queries.collect()]:
        scored = []
        for i, w in words.items():
            tf = Counter(w)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in {low(x) for x in WORD.findall(text or "")} if tf[t])
            if s > 0:
                scored.append((-round(s, 9), i))
        want = sorted(scored)[:5]
        assert [d for d, _ in got[q]] == [d for _, d in want]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want])
    assert search.search(docs.limit(0), queries, 5).count() == 0 and search.search(docs, queries.limit(0), 5).count() == 0
