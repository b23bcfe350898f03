"""Language identification of words, spans and documents.

The scripts of a word's letters narrow its candidates to the languages that were seen in them. Each candidate scores the
word by its letter trigrams; a Viterbi pass over a document's words, with a penalty for every switch, labels spans of
mixed text. The document's language is the one with most letters, its score that share of the letters.

Trigram counts come from at most about ``MOST_TAUGHT`` documents a language, picked by a hash of doc_id. All counts of these
documents are kept: the model grows with the languages and the different trigrams that each uses, and is held as a list of
the pairs that occur where a full table of languages by trigrams would be large.

Most documents are in one language throughout. That staying in the best one is the best path can be told from sums alone: no
stretch of words gains more for another language than its switches cost. Only the other documents are walked, many at a
time, one word position of all of them after another.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MOST_TAUGHT = 3000
DENSE_CELLS = 1 << 22
LEAST_SHARE = 0.01
SWITCH_PENALTY = 6.0
CACHE_CELLS = 1 << 21  # scores of words that a task keeps
WORDS_AT_ONCE = 1 << 20
NEGLIGIBLE = 1e-3
NO_LANGUAGE = "und"

_WORDS = re.compile(r"[^\W\d_]+").findall

#: Where ranges of scripts begin (code point, script).
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "other"),
    (0x20000, "Han"), (0x323B0, "other"),
)
_STARTS = [start for start, _ in SCRIPTS]
_NOT_LATIN = chr(SCRIPTS[1][0])


def script_of(char: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(char)) - 1][1]


def held_out(doc_id: Column) -> Column:
    """A third of the documents, from which nothing is learned."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


@dataclass
class Model:
    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray | None  # a row of log-probabilities by language for each trigram, the last one for all others
    others: np.ndarray  # that last row; without scores, places and gains from starts[i] on say what trigram i adds to it
    starts: list[int]
    places: np.ndarray
    gains: np.ndarray
    scripts: dict[str, np.ndarray]  # by script, 0 for candidates and a large penalty for the rest
    seen: dict[str, tuple[int, int]] = field(default_factory=dict)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and the number of letters, of many words."""
        if self.scores is None or not words:
            found = [self.word(w) for w in words]
            return np.array([f for f, _ in found]).reshape(len(words), len(self.languages)), np.array([n for _, n in found], np.int64)
        get, other, at = self.grams.get, len(self.grams), []
        for w in words:
            padded = f" {w} "
            at += [get(padded[i : i + 3], other) for i in range(len(w))]
        length = np.fromiter(map(len, words), np.int64, len(words))
        found = np.add.reduceat(self.scores[at], np.cumsum(length) - length, axis=0)
        found -= found.max(1, keepdims=True)
        latin, letters = self.scripts.get("Latin", 0.0), length.copy()
        for i, w in enumerate(words):
            if max(w) < _NOT_LATIN and w.isalpha():
                found[i] += latin
            else:
                found[i], letters[i] = self.word(w)
        return found, letters

    def word(self, word: str) -> tuple[np.ndarray, int]:
        """Scores by language, and the number of letters."""
        letters = [c for c in word if c.isalpha()]
        if not letters:
            return np.zeros(len(self.languages)), 0
        at = [self.grams.get(g, len(self.grams)) for g in _grams(word)]
        if self.scores is not None:
            found = self.scores[at].sum(0)
        else:
            found = self.others * len(at)
            for i in at:
                if i < len(self.grams):
                    here = slice(self.starts[i], self.starts[i + 1])
                    found[self.places[here]] += self.gains[here]
        script = Counter(map(script_of, letters)).most_common(1)[0][0]
        return found - found.max() + self.scripts.get(script, 0.0), len(letters)


def learn(docs: DataFrame, most: int = MOST_TAUGHT) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang) that are not held out; None if there are none with letters."""
    common.small_batches(docs.sparkSession)
    taught = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}
    if not sizes:
        return None
    by_lang = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    picked = taught.filter(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.element_at(by_lang, F.col("lang"))) < most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = grams.setdefault(lang, Counter())
                for w, n in Counter(_WORDS(text.lower())).items():
                    for g in _grams(w):
                        here[g] += n
        rows = [(lang, g, n) for lang, c in grams.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    counted = picked.select("text", "lang").mapInArrow(common.lean(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    return _model(rows) if rows.num_rows else None


def _model(rows: pa.Table) -> Model:
    """The model of all counted pairs (lang, gram, n)."""

    def coded(column: str) -> tuple[list[str], np.ndarray]:
        """The different values in code-point order, and the place of each row's."""
        found = rows[column].combine_chunks().dictionary_encode()
        values = found.dictionary.to_pylist()
        order = sorted(range(len(values)), key=lambda i: values[i].encode())
        place = np.zeros(len(values), np.int32)
        place[order] = np.arange(len(values))
        return [values[i] for i in order], place[found.indices.to_numpy()]

    (languages, lang), (names, gram), n = coded("lang"), coded("gram"), rows["n"].to_numpy()
    order = np.lexsort((lang, gram))
    lang, gram, n = lang[order], gram[order], n[order]
    of_gram = [script_of(g[1]) if g[1].isalpha() else "" for g in names]
    known = {s: k for k, s in enumerate(sorted(set(of_gram) - {""}))}
    script = np.array([known.get(s, -1) for s in of_gram])[gram]
    scripts = {s: np.bincount(lang[script == k], n[script == k], len(languages)) for s, k in known.items()}
    total = np.bincount(lang, n, len(languages)) + 0.5 * (len(names) + 1)
    others, scores = np.log(0.5 / total), None
    if (len(names) + 1) * len(languages) <= DENSE_CELLS:
        counts = np.zeros((len(names) + 1, len(languages)))
        counts[gram, lang] = n
        scores = np.log((counts + 0.5) / total)
    starts = np.searchsorted(gram, np.arange(len(names) + 1)).tolist()
    shares = {s: x / np.maximum(1, sum(scripts.values())) for s, x in scripts.items()}
    penalty = {s: np.where(x >= LEAST_SHARE, 0.0, -1e3) if (x >= LEAST_SHARE).any() else np.zeros(len(languages)) for s, x in shares.items()}
    return Model(languages, {g: i for i, g in enumerate(names)}, scores, others, starts, lang, np.log((n + 0.5) / 0.5), penalty)


def viterbi(scores: np.ndarray, word: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the words of many documents. scores: a row by language for each distinct word; word: row of each word, documents one after another."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents longer than each position
    kind = np.min_scalar_type(scores.shape[1])
    labels = np.zeros(len(word), kind)
    best_before = np.zeros(len(word), kind)
    stayed = np.zeros((len(word), scores.shape[1]), bool)
    state = np.zeros((len(sizes), scores.shape[1]))
    for t in range(longest):
        m = active[t]
        at, now = starts[:m] + t, state[:m]
        if t:
            top = now.max(1, keepdims=True)
            best_before[at] = now.argmax(1)
            now = now - top
            stayed[at] = now >= -penalty
            now = np.maximum(now, -penalty)
        state[:m] = now + scores[word[at]]
    last = np.zeros(len(sizes), np.int64)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        here = last[:m].copy()
        ends = sizes[:m] == t + 1
        if ends.any():
            here[ends] = state[:m][ends].argmax(1)
        labels[at] = here
        last[:m] = np.where(stayed[at, here], here, best_before[at])
    return labels


def label_words(scores: np.ndarray, word: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """What ``viterbi`` gives (but for ties between whole paths), without a walk where one language is best throughout.

    Let L be the best single language and g[M] the most that a stretch of words scores higher in M than in L. A path of r
    runs pays r - 1 switches. With a run in L, each other run gains at most the largest g and costs a switch; without one,
    neighbouring runs are in different languages and gain at most the two largest g together. So if these two add up to
    less than a switch, staying in L is best.
    """
    labels = np.zeros(len(word), np.min_scalar_type(scores.shape[1]))
    there = np.flatnonzero(lengths)
    if not len(there):
        return labels
    size = lengths[there]
    starts = np.cumsum(size) - size
    columns = range(scores.shape[1])
    total = np.stack([np.add.reduceat(scores[:, m][word], starts) for m in columns], 1)
    best = total.argmax(1)
    own = np.repeat(best, size)
    base = scores[word, own]
    largest, second = np.zeros(len(there)), np.zeros(len(there))
    floor = 4 * penalty  # a gain below this ends any stretch; as a bound it keeps sums small
    apart = np.repeat(np.arange(len(there)) * (floor * len(word) + 1), size)
    for m in columns:
        gain = np.maximum(scores[:, m][word] - base, -floor)
        upto = np.cumsum(gain) - apart
        most = np.maximum.reduceat(upto - np.minimum.accumulate(upto - gain), starts)
        most = np.where(best == m, 0.0, np.maximum(most, 0.0))
        second = np.maximum(second, np.minimum(largest, most))
        largest = np.maximum(largest, most)
    clear = largest + second < penalty - NEGLIGIBLE
    labels[:] = own
    if not clear.all():
        walked = np.repeat(~clear, size)
        labels[walked] = viterbi(scores, word[walked], size[~clear], penalty)
    return labels


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, spans: bool = False, prefix: str = "") -> DataFrame:
    """Adds lang_pred and score (and spans: array of first word, words, lang) to every row of ``docs`` (text).

    ``und`` with score 0 for a null text, one without letters, or without a model. Words are runs of letters. Ties go to the
    language that is lower in code-point order; of an empty table come no rows, of rows that repeat as many. Texts are read whole:
    the words of one document, as numbers, and its scores by language must fit a task. The new names start with ``prefix``; a column that already has such a name
    is replaced.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [prefix + c for c in ("lang_pred", "score", "spans")][: 2 + spans]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n_lang = len(model.languages) if model else 0
        names = [*(model.languages if model else []), NO_LANGUAGE]
        most_words = max(1000, CACHE_CELLS // max(1, n_lang))
        index: dict[str, int] = {}
        table, letters = np.zeros((1024, n_lang)), np.zeros(1024)

        def found_in(text: str | None) -> np.ndarray:
            """Numbers of a text's words in the table, which grows by those it lacks."""
            nonlocal table, letters
            found = _WORDS(text.lower()) if text and model else []
            try:
                return np.array(list(map(index.__getitem__, found)), np.int32)
            except KeyError:
                new = [w for w in dict.fromkeys(found) if w not in index]
                first, last = len(index), len(index) + len(new)
                while last > len(table):
                    table, letters = np.concatenate([table, np.zeros_like(table)]), np.concatenate([letters, np.zeros_like(letters)])
                table[first:last], letters[first:last] = model.words(new)
                index.update(zip(new, range(first, last), strict=True))
                return np.array(list(map(index.__getitem__, found)), np.int32)

        def labelled(rows: pa.RecordBatch, words: list[np.ndarray]) -> pa.RecordBatch:
            lengths = np.array([len(w) for w in words], np.int64)
            flat = np.concatenate(words)
            labels = label_words(table, flat, lengths, SWITCH_PENALTY) if model else np.zeros(0, np.uint8)
            cell = np.repeat(np.arange(len(words)), lengths) * max(1, n_lang) + labels
            by_lang = np.bincount(cell, letters[flat], len(words) * max(1, n_lang)).reshape(len(words), -1)
            total = by_lang.sum(1)
            best = np.where(total > 0, by_lang.argmax(1), len(names) - 1)
            out = [*rows.select(keep).columns, pa.array([names[b] for b in best.tolist()], pa.string()), pa.array(by_lang.max(1) / np.maximum(total, 1), pa.float64())]
            if spans:
                ends = np.cumsum(lengths)
                runs = []
                for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                    cuts = [0, *(np.flatnonzero(np.diff(labels[a:b])) + 1).tolist(), b - a]
                    runs.append([{"first": i, "words": j - i, "lang": names[labels[a + i]]} for i, j in zip(cuts, cuts[1:], strict=False) if j > i])
                out.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            return pa.RecordBatch.from_arrays(out, names=[*keep, *added])

        for batch in batches:
            column, first, words, held = batch.column(batch.schema.get_field_index("text")), 0, [], 0
            for row in range(batch.num_rows):
                words.append(found_in(column[row].as_py()))
                held += len(words[-1])
                if held * max(1, n_lang) >= WORDS_AT_ONCE or len(index) > most_words:
                    yield labelled(batch.slice(first, row + 1 - first), words)
                    first, words, held = row + 1, [], 0
                    if len(index) > most_words:
                        index.clear()
            if words:
                yield labelled(batch.slice(first), words)

    types = ("string", "double", "array<struct<first: int, words: int, lang: string>>")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema] + [f"`{c}` {t}" for c, t in zip(added, types, strict=False)]
    return docs.mapInArrow(common.lean(label), ", ".join(fields))


def op10_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language: doc_id, held_out, lang_pred, score."""
    docs = common.documents(spark, sf_dir)
    model = learn(docs)
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
