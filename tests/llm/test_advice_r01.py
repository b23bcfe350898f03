
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from scenequery.llm import dac, language, mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shard_words", [mixing.SHARD_WORDS, 30_000])
def test_whole_documents_meet_each_sources_target(spark, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    rows = []
    for source, n in zip("abcdefgh", [30, 60, 20, 30, 10, 20, 30, 10], strict=True):
        rows += [(len(rows) + k, "w " * [500, 1000, 1500, 1000][k % 4], source) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(docs, copies=True).collect()
    kept, taken, target, longest, shards = defaultdict(int), defaultdict(int), {}, defaultdict(int), {}
    for r in mixed:
        assert int(r.taken / r["size"]) <= r.copies <= -(-r.taken // r["size"])
        taken[r.source] += r.taken
        target[r.source], longest[r.source], shards[r.source] = r.target, max(longest[r.source], r["size"]), -(-r.source_size // shard_words)
    out = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    for r in out:
        kept[r.source] += len(r.text.split())
    assert min(target[s] / sum(r["size"] for r in mixed if r.source == s) for s in target) < 0.5
    for s in target:
        assert abs(kept[s] - taken[s]) <= longest[s] * shards[s] + 1
        assert abs(kept[s] - target[s]) <= 0.15 * target[s] + longest[s] / 2
    again = corpus_pipeline.mix_sources(spark, docs.repartition(7), SF).collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in out)


def test_every_letter_below_0x250_inside_words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), dac.WordTokenizer(path)
    for c in map(chr, range(0x250)):
        for text in (f"{c}la", f"a{c}b", f"Ha{c}", f"x {c} 1{c}"):
            assert np.frombuffer(own.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, hex(ord(c))
    assert own.simple("Straße") and not own.simple("\u018fla")


def test_small_languages_stay_beside_one_of_many_trigrams(spark):
    rng = random.Random(5)
    han = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(70_000))
    rows = [(k, han, "zh") for k in range(9)] + [(100 + k, "little known words of it", "aa") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == ["aa", "zh"]
    got = language.identify(docs.filter("lang = 'aa'"), model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 1.0)}


def test_model_as_list_of_pairs_equals_the_full_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = language.learn(docs)
    monkeypatch.setattr(language, "DENSE_CELLS", 0)
    pairs = language.learn(docs)
    assert full.scores is not None and pairs.scores is None
    for word in ("the", "und", "zzzqx", "привет", "中文", "été", "1", "a"):
        assert np.allclose(full.word(word)[0], pairs.word(word)[0]) and full.word(word)[1] == pairs.word(word)[1]


def test_viterbi_of_more_than_256_languages():
    scores = np.zeros((2, 300))
    scores[0, 299], scores[1, 256] = 50.0, 50.0
    word = np.array([0, 0, 1, 1, 0], np.int32)
    assert language.viterbi(scores, word, np.array([4, 1]), 6.0).tolist() == [299, 299, 256, 256, 299]
