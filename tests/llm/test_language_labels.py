"""Labels of words and documents against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scenequery.llm import common, language

SF = "/root/testdata/sf0.001"


def value(scores, path, penalty):
    return sum(scores[t][m] for t, m in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


def plain_viterbi(scores, penalty):
    """The best path of one document, by the textbook recursion."""
    state, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(state)), key=lambda m: (state[m], -m))
        back.append([m if state[m] >= state[top] - penalty else top for m in range(len(state))])
        state = [max(state[m], state[top] - penalty) + row[m] for m in range(len(state))]
    path = [max(range(len(state)), key=lambda m: (state[m], -m))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("n_lang", [1, 2, 3, 5])
@pytest.mark.parametrize("spread", [0.5, 2.0, 8.0])
def test_labels_are_best_paths(n_lang, spread):
    rng = np.random.default_rng(int(n_lang * 10 + spread))
    scores = rng.normal(0, spread, (40, n_lang)).round(3)
    scores -= scores.max(1, keepdims=True)
    scores[:5, 1:] = -1e3
    lengths = rng.integers(0, 25, 200)
    home = np.repeat(rng.integers(0, 2, 200), lengths)
    word = np.where(home == 1, rng.integers(0, 8, lengths.sum()), rng.integers(0, 40, lengths.sum())).astype(np.int32)
    got = language.label_words(scores, word, lengths, 6.0)
    at = 0
    for n in lengths.tolist():
        if n:
            own = scores[word[at : at + n]].tolist()
            assert math.isclose(value(own, got[at : at + n].tolist(), 6.0), value(own, plain_viterbi(own, 6.0), 6.0), abs_tol=1e-6)
        at += n


def test_many_words_at_once_score_like_one(spark):
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    words = ["the", "über", "a", "привет", "中文", "x²", "½", "éé", "word" * 50]
    scores, letters = model.words(words)
    for w, s, n in zip(words, scores, letters, strict=True):
        assert np.allclose(s, model.word(w)[0]) and n == model.word(w)[1]


def test_whole_query_against_a_plain_version(spark):
    """Everything again in plain Python: counts, scripts, scores, best paths, labels of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 3 == 1 for d in docs}
    words = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    counts = defaultdict(Counter)
    for d in docs:
        if not held[d.doc_id] and d.text is not None and d.lang is not None:
            for w in words(d.text):
                counts[d.lang].update(f" {w} "[i : i + 3] for i in range(len(w)))
    langs, names = sorted(counts), {g for c in counts.values() for g in c}
    total = {x: sum(c.values()) + 0.5 * (len(names) + 1) for x, c in counts.items()}
    script = lambda c: language.script_of(c)
    by_script = {x: Counter() for x in langs}
    for x, c in counts.items():
        for g, n in c.items():
            if g[1].isalpha():
                by_script[x][script(g[1])] += n
    seen = {s for c in by_script.values() for s in c}
    fits = {s: [by_script[x][s] / max(1, sum(by_script[x].values())) >= language.LEAST_SHARE for x in langs] for s in seen}

    def score(w):
        letters = [c for c in w if c.isalpha()]
        if not letters:
            return [0.0] * len(langs), 0
        found = [sum(math.log((counts[x][f" {w} "[i : i + 3]] + 0.5) / total[x]) for i in range(len(w))) for x in langs]
        s = Counter(map(script, letters)).most_common(1)[0][0]
        fit = fits.get(s, [True] * len(langs))
        return [v - max(found) + (0 if f or not any(fit) else -1e3) for v, f in zip(found, fit, strict=True)], len(letters)

    got = {r.doc_id: r for r in language.op10_viterbi_language(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        by_lang = Counter()
        scored = [score(w) for w in words(d.text or "")]
        for m, (_, n) in zip(plain_viterbi([s for s, _ in scored], language.SWITCH_PENALTY) if scored else [], scored, strict=True):
            by_lang[langs[m]] += n
        all_ = sum(by_lang.values())
        best = min(by_lang, key=lambda x: (-by_lang[x], x)) if all_ else "und"
        r = got[d.doc_id]
        assert (r.held_out, r.lang_pred) == (held[d.doc_id], best)
        assert math.isclose(r.score, by_lang[best] / all_ if all_ else 0.0, abs_tol=1e-9)


def test_many_languages_and_a_tiny_one(spark):
    """300 languages with words of their own, one of them with three short documents: all are learned and told apart."""
    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03d}": ["".join(rng.choice(alphabet) for _ in range(7)) for _ in range(12)] for k in range(300)}
    rows = [(k * 10 + j, " ".join(rng.sample(w, 3 if lang == "l299" else 9)), lang) for k, (lang, w) in enumerate(own.items()) for j in range(3 if lang == "l299" else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.learn(docs)
    taught = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert set(model.languages) == taught == set(own)
    got = language.identify(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    assert any(r.lang_pred == "l299" for r in got if r.lang == "l299") and {r.lang_pred for r in got if int(r.lang[1:]) > 256}


def test_empty_table_and_mixed_text(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], schema)
    assert language.learn(none) is None and language.identify(none, None).count() == 0
    docs = common.documents(spark, SF)
    model = language.learn(docs)
    en, de = (next(r.text for r in docs.filter(f"lang = '{x}' and n_chars > 400").collect()) for x in ("en", "de"))
    rows = [(1, f"{en} {de} {en}", None), (2, de * 300, None), (3, None, None), (4, "12 !", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, schema), model, spans=True).collect()}
    assert [s.lang for s in got[1].spans if s.words > 20] == ["en", "de", "en"]
    assert (got[2].lang_pred, got[3].lang_pred, got[4].lang_pred) == ("de", "und", "und")
