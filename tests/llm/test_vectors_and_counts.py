"""Token counts, whitening and hard negatives against versions that share no code with them."""

import json
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenequery.llm import common, counts, negatives, vectors, whitening

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return counts.Counter(PATH, counts._checked(PATH), counts.character_classes(PATH))


# ---- token counts ----------------------------------------------------------------------------------------------------------


def test_op13_equals_the_library(spark, library):
    docs = common.documents(spark, SF).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts.op13_transducer_counts(spark, SF).collect()}
    want = {d.doc_id: (len((d.text or "").encode()), n, n > 512) for d, n in zip(docs, library([d.text or "" for d in docs]), strict=True)}
    assert got == want and len(got) == len(docs)


def test_mixtures_of_everything_that_splits(counter, library):
    rng = random.Random(1)
    parts = ["a", "b", "s", "t", "'", "'", "'s", "'re", "'r", "'ll", "'S", " ", " ", "  ", "\n", "\t", "\xa0", "　", "\x85", "é", "ß", "中", "文", "1", "٣", "½", "!", "-", "<|endoftext|>", "<|endof", "\U0001f600", "\U00020000", "̀", "the", "ing", " the", "\x00", "A", "Ᲊ", "﻿"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(10_000))]
    assert counter([t.encode() for t in texts]).tolist() == library(texts)
    texts = ["".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(3000)]
    assert counter([t.encode() for t in texts]).tolist() == library(texts)


def test_every_code_point_is_classed_as_the_library_does(counter, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in points[k : k + 512]) for k in range(0, len(points), 512)]
    assert counter([t.encode() for t in texts]).tolist() == library(texts)


def test_long_pre_tokens_go_in_chunks(counter, library):
    rng = random.Random(2)
    sized = [["x" * n, "ab" * n, "中" * n] for n in (1, 341, 342, 512, 1023, 1024, 1025, 2047, 2048, 2049, 5000)]
    texts = [t for row in sized for t in row] + ["".join(rng.choice(letters) for _ in range(20_000)) for letters in ("ACGT", "abcdefghij", "=-", "中文字", "ab")] + ["a" * 30_000 + "b" + "a" * 30_000, "\n" * 7777, " " * 12345, "aaaaaaab" * 3000]
    assert counter([t.encode() for t in texts]).tolist() == library(texts)


def test_what_a_map_lacks_is_run_for_itself(monkeypatch, library):
    """Chunks so short, and states so few, that maps lack most states."""
    monkeypatch.setattr(counts, "CHUNK", 16)
    monkeypatch.setattr(counts, "AHEAD", 1)
    monkeypatch.setattr(counts, "WAYS", 1)
    small = counts.Counter(PATH, counts._checked(PATH), counts.character_classes(PATH))
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(700)) for _ in range(40)] + ["a" * 999, "internationalization" * 30]
    assert small([t.encode() for t in texts]).tolist() == library(texts)


def test_states_are_forgotten_and_texts_cut(monkeypatch, counter, library):
    monkeypatch.setattr(counts, "MOST_STATES", 50)
    monkeypatch.setattr(counts, "SLICE", 1000)
    texts = [" ".join(["word", "other's", "über 12"] * 400), "x" * 5000, "a\n b  c<|endoftext|>" * 300]
    assert counter([t.encode() for t in texts]).tolist() == library(texts)
    assert len(counter.transducer.keys) < 10_000


def test_state_maps_compose():
    """A scan over three pre-tokens of 1, 5 and 4 chunks with random maps, against walking them."""
    rng = np.random.default_rng(4)
    rank = np.array([0, *range(5), *range(4)])
    enter = np.array([[0, 0], *([0, 0] if r == 0 else rng.permutation(4)[:2].tolist() for r in rank[1:])])
    leave, delta = rng.integers(0, 4, (10, 2)), rng.integers(-3, 9, (10, 2))
    leave[rank == 0] = leave[rank == 0][:, :1]
    delta[rank == 0] = delta[rank == 0][:, :1]
    got, total = counts.compose(enter, leave, delta, rank)
    state = count = 0
    for c, r in enumerate(rank):
        if r == 0:
            state, count = 0, 0
        at = np.flatnonzero(enter[c] == state) if state >= 0 else []
        state, count = (int(leave[c, at[0]]), count + int(delta[c, at[0]])) if len(at) else (-1, 0)
        assert got[c, 0] == state and (state < 0 or total[c, 0] == count)


def test_counts_of_odd_tables(spark, library):
    rows = [(1, None, 5, "x"), (None, "", 6, None), (2, "two words", None, "y"), (2, "two words", None, "y"), (3, "<|endoftext|>", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, extra string")
    got = sorted((r.doc_id or 0, r.text or "", r.n_bytes, r.n_tokens, r.over_limit, r.extra) for r in counts.count_tokens(docs, PATH, limit=1).collect())
    assert got == sorted(((i or 0, t or "", len(t or ""), n, n > 1, x) for (i, t, _, x), n in zip(rows, library([r[1] or "" for r in rows]), strict=True)), key=lambda r: r[:4])
    assert counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_other_tokenizers_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="plain"):
        counts._checked(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="plain"):
        counts._checked(public_tokenizers.path("word_bpe_49k.json"))


# ---- whitening -------------------------------------------------------------------------------------------------------------


def test_op11_equals_plain_linear_algebra(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r.embedding for r in t], float)).astype(np.int64) + 1_000_000
    fitted = np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(0)
    z = fitted - s / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    got = sorted(whitening.op11_cholesky_jacobi(spark, SF).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 16 * len(t) and [r.component for r in got[:16]] == list(range(1, 17))
    w = np.array([r.whitened for r in got]).reshape(len(t), 16)
    want = (x - s / n) @ u[:, :16] / np.sqrt(e[:16])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert np.allclose([r.explained for r in got[:16]], e[:16] / e.sum(), rtol=1e-10)
    assert [r.deviation for r in got[::16]] == ((n * x - s) ** 2).sum(1).tolist() and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (7, 3), (40, 40), (41, 9)])
def test_factor_and_rotations(shape):
    rng = np.random.default_rng(sum(shape))
    a = rng.normal(size=shape) * 10.0 ** rng.integers(-1, 2, shape[1])
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape == (shape[0], min(shape)) and np.abs(factor @ factor.T - v).max() <= 1e-12 * np.abs(v).max()
    values, directions = whitening.one_sided_jacobi(factor)
    want = np.linalg.eigvalsh(v)[::-1][: len(values)]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-12 * want[0]) and (np.diff(values) <= 0).all()
    assert np.abs(directions.T @ directions - np.eye(len(values))).max() < 1e-12
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + more)


def test_whitening_of_odd_tables(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0, 0.0], 9), (2, [2.0, 1.0, 0.0], 8), (2, [2.0, 1.0, 0.0], 8), (None, [3.0, 5.0, 0.0], None), (4, None, 1), (5, [1.0, None, 0.0], 1), (6, [nan, 1.0, 0.0], 1), (7, [inf, 1.0, 0.0], 1), (8, [4.0, 4.0], 1), (9, [], 1)]
    got = whitening.whiten(table(spark, rows, ", component int")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 2, 2, 8, 9) for c in (1, 2))  # the third entry never varies
    assert {r.n for r in got} == {5} and got[0].identity_error < 1e-12 and sum(r.explained for r in got if r.vec_id == 1) == pytest.approx(1)
    x = {1: (64, 128), 2: (128, 64), 0: (192, 320), 8: (256, 256), 9: (0, 0)}
    s = np.sum(list(x.values()), axis=0)
    assert all(r.deviation == sum((5 * np.array(x[r.vec_id or 0]) - s) ** 2) for r in got)
    for few in ([(1, [1.0, 2.0])] * 3, [(1, None)], []):
        assert whitening.whiten(table(spark, few)).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e300])])).collect()
    far = whitening.whiten(table(spark, [(1, [1e9]), (2, [-1e9])])).collect()
    assert [r.deviation for r in far] == [None, None] and [abs(r.whitened) for r in far] == [1.0, 1.0]


def test_packed_numbers():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-(2**b), 2**b, (20, 3)) for b in (3, 7, 8, 15, 16, 31, 32, 61)] + [[[-128, 127, 0]], [[-129, 0, 0]], [[32767, -32768, 0]]])
    found = vectors.packed(x)
    assert (vectors.unpacked(found, 3) == x).all() and len({bytes(f) for f in found}) == len(np.unique(x, axis=0))
    assert [len(f) for f in vectors.packed(np.array([[-128], [128], [-(2**31)], [2**31]]))] == [2, 3, 5, 9]


# ---- hard negatives --------------------------------------------------------------------------------------------------------


def plain_negatives(rows, every, positives=5, negatives=10, scale=256, least=30, most=90):
    """(anchor, positive, rank, negative, positive score, negative score) by looking at everything; rows are (id, label, vector)."""
    x = [[math.floor(scale * c) for c in v] for _, _, v in rows]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    found = []
    for i, (anchor, label, _) in enumerate(rows):
        if anchor % every:
            continue
        scored = sorted((-dot(x[i], x[j]), other, lab) for j, (other, lab, _) in enumerate(rows))
        for p, positive, _ in [s for s in scored if s[2] == label and s[1] != anchor][:positives]:
            window = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p][:negatives]
            found += [(anchor, positive, k, other, -p, -s) for k, (s, other, _) in enumerate(window, 1)]
    return sorted(found)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mine(df, **options).collect())


def test_op12_equals_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in negatives.op12_hilbert_negatives(spark, SF).collect())
    assert got == plain_negatives(rows, 100) and got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_ties_and_copies(spark, monkeypatch, seed):
    """Small blocks, pages and groups over clustered vectors, so that zone maps leave blocks out; ties by copies of vectors."""
    for name, value in (("BLOCK_BYTES", 512), ("PAGE_BLOCKS", 3), ("ZONE_BYTES", 1 << 12), ("GROUP", 4)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5)) * 3
    rows = [(i, int(rng.integers(3)) if seed > 1 else i % 6 // 2, (centres[i % 6] + rng.normal(size=5) * 0.2).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df, every=20) == plain_negatives(rows, 20)
    # of a group's blocks only some are read
    placed = common.staged(negatives._placed(df.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("_vector")), 5, 256), "placed")
    zones = [r.asDict() for r in negatives._blocks(placed, 5).collect()]
    groups = [r.asDict() | {"floors": None, "tops": None} for r in negatives._groups(placed, 20, 5).collect()]
    read = sum(negatives.Asked(g, 5, 5, 1).blocks(zones, 5).sum() for g in groups)
    asked = sum(len(g["ids"]) // 8 for g in groups)
    assert len(zones) > 20 and read < 0.5 * asked * len(zones)


def test_negatives_of_odd_tables(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.5]), (3, 2, [0.5]), (3, 2, [0.5]), (4, 3, [-1.0, 0.0]), (5, 3, []), (10, 3, [-0.5, 0.0]), (20, 9, [1.0, 1.0])]
    bad = [(6, None, [0.5, 0.5]), (7, 2, None), (8, 2, [None, 0.5]), (9, 2, [math.nan, 0.5]), (None, 2, [0.5, 0.5]), (11, 2, [math.inf, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, label int, embedding array<double>, rank string")
    filled = [(i, lab, [*v, 0.0, 0.0][:2]) for i, lab, v in rows]
    got = mined(df, every=10)
    assert got == plain_negatives(filled, 10) and {r[0] for r in got} == {0}  # the others' windows lie where no row is
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id = 20"), every=10) == []
    repeated = df.unionByName(df.filter("vec_id = 0"))
    assert mined(repeated, every=10) == sorted(got * 2)


def test_the_curve_goes_from_cell_to_neighbouring_cell():
    for dims, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(9)
    for size in (100, 10_000, 2**24):
        a, x = rng.integers(-size, size, (5, 7)), rng.integers(-size, size, (40, 7))
        exact = a.astype(object) @ x.astype(object).T
        assert (negatives.products(a, x) == exact).all()
        low, high = negatives.bounds(a, x.min(0)[None], x.max(0)[None])
        assert (low[:, 0] <= exact.min(1)).all() and (high[:, 0] >= exact.max(1)).all()
    with pytest.raises(ValueError, match="products"):
        negatives.products(np.array([[2**40]]), np.array([[2**40]]))


# ---- staged tables ---------------------------------------------------------------------------------------------------------


def test_two_runs_at_once_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from scenequery.llm import jaccard

    want = sorted(tuple(r) for r in jaccard.op1_signature_trees(spark, SF).collect())
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: sorted(tuple(r) for r in jaccard.op1_signature_trees(spark, SF).collect()), range(2)))
    assert both == [want, want]


@pytest.mark.parametrize("flush", [40, 10**6])
def test_a_shingle_that_many_texts_share_loses_no_link(spark, monkeypatch, flush):
    """A third of all different texts begin alike; tasks hand over early (40) or late; against all pairs."""
    from scenequery.llm import jaccard
    from test_text_operators import linked

    monkeypatch.setattr(jaccard, "FLUSH", flush)
    rng = random.Random(11)
    common_words = [f"c{k}" for k in range(9)]
    rows = []
    for k in range(240):
        own = [f"w{rng.randrange(50)}" for _ in range(rng.choice([2, 9, 40]))]
        rows.append((k, " ".join([*common_words, *own] if k % 3 == 0 else own)))
    for k in range(60):  # near copies of the texts that begin alike
        words = rows[3 * (k % 40)][1].split()
        words[-1] = f"y{k % 2}"
        rows.append((1000 + k, " ".join(words)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = linked(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and any(i != c for i, (_, c) in want.items())


# ---- toxicity --------------------------------------------------------------------------------------------------------------


def test_op6_follows_the_cumulative_link_formula(spark):
    """All four columns of every document from the fitted weights and cuts, worked out word by word."""
    import regex

    from scenequery.llm import toxicity

    sf = "/root/testdata/sf0.01"
    docs = common.documents(spark, sf)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1] and model.weights
    letters = regex.compile(r"[^\W\d_]+")
    starts = {len(f) - 1 for f in model.weights if f.endswith("*")}
    got = {r.doc_id: r for r in toxicity.op6_ordinal_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        words = set(letters.findall((d.text or "").lower()))
        marks = {w for w in words if w in model.weights} | {w[:k] + "*" for w in words for k in starts if len(w) > k and w[:k] + "*" in model.weights}
        total = sum(model.weights[m] for m in marks)
        above = [1 / (1 + math.exp(min(40, max(-40, cut - total)))) for cut in model.thresholds]
        r = got[d.doc_id]
        assert r.score == pytest.approx(above[0], abs=1e-9) and r.expected_severity == pytest.approx(sum(above), abs=1e-9)
        if min(abs(a - 0.5) for a in above) > 1e-9:
            assert r.grade == sum(a >= 0.5 for a in above) and r.toxic == (above[0] >= 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    caught = [got[i].toxic for i, t in labels.items() if t == 1 and i in got]
    clean = [got[i].toxic for i, t in labels.items() if t == 0 and i in got]
    assert sum(caught) / len(caught) > 0.6 and sum(clean) / len(clean) < 0.02  # a model that calls all of them clean fails here


def test_very_long_texts(spark):
    """A text of two million words next to short ones, through operators that had no such test."""
    from scenequery.llm import language, mixing, toxicity

    words = "the quick brown fox jumps over the lazy dog and runs away from it "
    rows = [(1, words * 150_000, "a", "en"), (2, "short one", "a", "en"), (3, None, "b", "de"), (4, words, None, "en"), (5, "der schnelle braune Fuchs springt über den faulen Hund und läuft davon", "b", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = toxicity.Model({"quick": 2.0}, [1.2, 3.0])
    graded = {r.doc_id: (r.grade, r.toxic, round(r.score, 6)) for r in toxicity.grade(docs, model).collect()}
    assert graded[1] == graded[4] and graded[1][1] and not graded[2][1] and not graded[3][1]
    learned = language.learn(docs)
    named = {r.doc_id: r.lang_pred for r in language.identify(docs, learned).collect()}
    assert set(named) == {1, 2, 3, 4, 5} and named[1] == named[4] and named[3] == "und"
    mixed = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    assert mixed[1][0] == 150_000 * 14 and mixed[3][0] == 0 and all(taken <= 2 * size for size, taken in mixed.values())
