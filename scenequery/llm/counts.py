"""Token counts of a byte-level BPE without its tokens: a compiled transducer whose transitions say by how much the count changes.

**Pre-tokens.** Whether one begins at a character depends on the classes of that character and its neighbours only, so all places of
a slice of texts are found at once (``word_starts``).

**Transducer.** Every prefix of a pre-token has an encoding, and the last token of the prefix is the one token that may follow the
last token of what comes before it: two tokens may be neighbours exactly if the library encodes their two strings together as
these two. So a state has to hold no more than this: for each place from which a token may still reach over the bytes to come,
the node of the vocabulary's trie reached from there, the last token of the prefix that ends there, and how many tokens that
prefix has less than the whole. A transition on a byte picks the new last token and carries the change of the count, which may
be negative, as longer tokens swallow shorter ones. States and transitions are compiled when they are first met, into one table
of (state, byte) -> (state, change), ``Transitions``; ``Transducer.counts`` walks all pre-tokens of a slice through it side by side, byte by byte.

**Chunks.** A pre-token longer than ``CHUNK`` bytes is cut into chunks that run side by side too. A chunk's state map tells for each of
a few states with which it may be entered the state and the change at its end; those states come from reading ``AHEAD`` bytes before
it from several places. Maps of a pre-token's chunks are composed by a parallel prefix scan that doubles its reach in each step.
What enters a chunk in a state that its map lacks is run through it for itself, so the counts are exact in any case.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 1024
AHEAD = 64
WAYS = 4
SLICE = 1 << 21  # bytes that are walked through at once
MOST_STATES = 400_000  # some 300 bytes each; beyond that a worker forgets them between two slices and compiles anew what it meets
TOKEN_LIMIT = 512

#: Classes of characters, and what follows an apostrophe in a contraction.
OTHER, LETTER, NUMBER, SPACE = range(4)
SHORT, LONG = "stmd", ("re", "ve", "ll")

_CUT = re.compile(rb"[!-~][ \n]")


# ---- pre-tokens ------------------------------------------------------------------------------------------------------------


def character_classes(path: str) -> bytes:
    """The class of every code point as the library at hand has it, compressed: its Unicode version is not Python's."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, OTHER, np.uint8)
    ranges = [(a, min(a + 4096, end)) for begin, end in ((0, 0xD800), (0xE000, 0x110000)) for a in range(begin, end, 4096)]
    while ranges:
        begin, end = ranges.pop()
        chars = "".join(map(chr, range(begin, end)))
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"), (SPACE, "\n")):
            if len(split(before + chars)) == 1:  # they are of the class of what stands before them
                table[begin:end] = kind
                break
        else:
            middle = (begin + end) // 2
            ranges += [(begin, middle), (middle, end)]
    return zlib.compress(table.tobytes(), 6)


def word_starts(chars: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: a mask over ``chars`` (code points). ``first`` marks the first character of each text."""
    n = len(chars)
    kind = np.concatenate([classes[chars], np.full(3, SPACE, np.uint8)])
    char = np.concatenate([chars, np.zeros(3, chars.dtype)])
    last = np.concatenate([first[1:], np.ones(4, bool)])
    space = kind == SPACE
    before_space = np.concatenate([[False], space[: n - 1]])
    same = np.concatenate([[False], kind[1:n] == kind[: n - 1]])
    after_blank = np.concatenate([[False], char[: n - 1] == 32])
    ends_run = ~space[1 : n + 1] & ~last[:n]  # the next character is no space: the last one of a run of spaces stands alone
    start = np.where(space[:n], ~before_space | ends_run, np.where(before_space, ~after_blank, ~same)) | first
    at = np.flatnonzero((char[:n] == 39) & start)
    at = at[~last[at]]
    if len(at):
        one = np.isin(char[at + 1], [ord(c) for c in SHORT])
        two = ~last[at + 1] & np.logical_or.reduce([(char[at + 1] == ord(a)) & (char[at + 2] == ord(b)) for a, b in LONG])
        start[at[one | two] + 1] = False
        after = np.concatenate([at[one] + 2, at[two & ~one] + 3])
        start[after[after < n]] = True
    return start


# ---- transducer ------------------------------------------------------------------------------------------------------------


class Transitions:
    """A hash table in one array: state * 256 + byte -> state * 256 + change + 128, read and written by arrays of them."""

    def __init__(self, bits: int = 16):
        self.bits, self.held, self.slots = bits, 0, np.full(1 << bits, -1, np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def get(self, key: np.ndarray) -> np.ndarray:
        """What the keys (32 bits) stand for, -1 for those that are not there."""
        place = self._place(key)
        found = self.slots[place]
        open_ = np.flatnonzero(((found >> 32) != key) & (found >= 0))
        while len(open_):
            place[open_] = (place[open_] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
            found[open_] = again = self.slots[place[open_]]
            open_ = open_[((again >> 32) != key[open_]) & (again >= 0)]
        return np.where(found >= 0, found & 0xFFFFFFFF, -1).astype(np.int32)

    def put(self, key: np.ndarray, to: np.ndarray) -> None:
        """Adds keys that are not there yet, each once."""
        if 2 * (self.held + len(key)) > len(self.slots):
            old = self.slots[self.slots >= 0]
            while 2 * (len(old) + len(key)) > 1 << self.bits:
                self.bits += 1
            self.held, self.slots = 0, np.full(1 << self.bits, -1, np.int64)
            self.put((old >> 32).astype(np.int32), old & 0xFFFFFFFF)
        self.held += len(key)
        entry, place = key.astype(np.int64) << 32 | to, self._place(key)
        while len(entry):
            free = self.slots[place] < 0
            self.slots[place[free]] = entry[free]
            left = self.slots[place] != entry
            entry, place = entry[left], (place[left] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)


class Transducer:
    """States have numbers, 0 is the one before a pre-token. A state is a tuple of numbers of (node, last token, count) triples."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        with open(path, encoding="utf-8") as f:
            spelled = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(_letters())}
        self.spelled = {token: s for s, token in spelled.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for s, token in spelled.items():
            node = 0
            for c in s:
                b = byte_of[c]
                after = self.children[node].get(b)
                if after is None:
                    after = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = after
            self.token[node] = token
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.may_follow.clear()
        self.triples, self.number_of = [(0, None, 0)], {(0, None, 0): 0}
        self.keys, self.states = [(0,)], {(0,): 0}
        self.transitions = Transitions()

    def _follows(self, last: int, token: int) -> bool:
        found = self.may_follow.get((last, token))
        if found is None:
            found = [t.id for t in self.model.tokenize(self.spelled[last] + self.spelled[token])] == [last, token]
            self.may_follow[last, token] = found
        return found

    def _compile(self, entry: int) -> int:
        """Where a state and byte (state * 256 + byte) lead: state * 256 + change + 128."""
        reached, new, change, byte = [], None, 0, entry & 255
        for i in self.keys[entry >> 8]:
            node, last, count = self.triples[i]
            node = self.children[node].get(byte)
            if node is None:
                continue
            token = self.token[node]
            if new is None and token is not None and (last is None or self._follows(last, token)):
                new, change = token, count + 1
            if self.children[node]:
                reached.append((node, last, count))
        if new is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        key = (*(self._triple((node, last, count - change)) for node, last, count in reached), self._triple((0, new, 0)))
        number = self.states.setdefault(key, len(self.keys))
        if number == len(self.keys):
            self.keys.append(key)
        return number * 256 + change + 128

    def _triple(self, triple: tuple[int, int | None, int]) -> int:
        number = self.number_of.setdefault(triple, len(self.triples))
        if number == len(self.triples):
            self.triples.append(triple)
        return number

    def run(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, change of the count) at the end of each stretch ``data[first : first + length]`` that is entered in ``state``."""
        order = np.argsort((CHUNK * 2 - length).astype(np.uint16), kind="stable")  # longest first
        active = len(length) - np.cumsum(np.bincount(length, minlength=1))
        at, now, change = first[order], state[order].astype(np.int32), np.zeros(len(first), np.int32)
        for k, m in enumerate(active[:-1].tolist()):
            entry = now[:m] * 256 + data[at[:m] + k]
            to = self.transitions.get(entry)
            missing = entry[to < 0]
            if len(missing):
                missing = np.unique(missing)
                self.transitions.put(missing, np.array([self._compile(e) for e in missing.tolist()], np.int64))
                to = self.transitions.get(entry)
            now[:m] = to >> 8
            change[:m] += (to & 255) - 128
        ends, total = np.empty_like(now), np.empty_like(change)
        ends[order], total[order] = now, change
        return ends, total

    def counts(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token ``data[first : first + length]``."""
        if len(self.keys) > MOST_STATES:
            self.forget()
        found = np.zeros(len(first), np.int64)
        short = length <= CHUNK
        found[short] = self.run(data, first[short], length[short], np.zeros(int(short.sum()), np.int32))[1]
        if not short.all():
            found[~short] = self._in_chunks(data, first[~short], length[~short])
        return found

    def _in_chunks(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        n = -(-length // CHUNK)
        word = np.repeat(np.arange(len(first)), n)
        head = np.cumsum(n) - n  # each pre-token's first chunk
        rank = np.arange(n.sum()) - head[word]
        begin = first[word] + rank * CHUNK
        size = np.minimum(CHUNK, length[word] - rank * CHUNK)
        # with which states each chunk may be entered
        ahead = np.minimum(rank[:, None] * CHUNK, AHEAD + np.arange(WAYS)[None, :]).ravel()
        enter = self.run(data, np.repeat(begin, WAYS) - ahead, ahead, np.zeros(len(ahead), np.int32))[0].reshape(-1, WAYS)
        # state maps: what becomes of each of them
        pairs, which = np.unique(np.repeat(np.arange(len(begin)), WAYS) << 32 | enter.ravel(), return_inverse=True)
        chunk = pairs >> 32
        out, change = self.run(data, begin[chunk], size[chunk], (pairs & 0xFFFFFFFF).astype(np.int32))
        leave, delta = out[which].reshape(-1, WAYS), change[which].reshape(-1, WAYS).astype(np.int64)
        scanned, total = compose(enter, leave, delta, rank)
        known, tokens = scanned[:, 0], total[:, 0]
        for w in np.flatnonzero(np.minimum.reduceat(known, head) < 0).tolist():  # entered in a state that a map lacks
            now, count = 0, 0
            for c in range(head[w], head[w] + n[w]):
                if known[c] >= 0:
                    now, count = known[c], tokens[c]
                    continue
                at = np.flatnonzero(enter[c] == now)
                if len(at):
                    now, count = leave[c, at[0]], count + delta[c, at[0]]
                else:
                    to, more = self.run(data, begin[c : c + 1], size[c : c + 1], np.array([now], np.int32))
                    now, count = int(to[0]), count + int(more[0])
            tokens[head[w] + n[w] - 1] = count
        return tokens[head + n - 1]


def compose(enter: np.ndarray, leave: np.ndarray, delta: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State maps of all stretches from a pre-token's first chunk (rank 0) to each of its chunks, as (state left in, change), in the
    order of the states that the first chunk may be entered in; -1 where a map lacks the state that it is entered in."""
    leave, delta = leave.copy(), delta.copy()
    enter, reach = enter.copy(), 1
    while reach <= rank.max(initial=0):
        later = np.flatnonzero(rank >= reach)
        before = later - reach
        meets = leave[before][:, :, None] == enter[later][:, None, :]
        at, known = meets.argmax(2), meets.any(2) & (leave[before] >= 0)
        rows = np.arange(len(later))[:, None]
        joined = np.where(known, leave[later][rows, at], -1), np.where(known, delta[before] + delta[later][rows, at], 0)
        enter[later], leave[later], delta[later] = enter[before], *joined
        reach *= 2
    return leave, delta


def _letters() -> list[str]:
    """How vocabularies of byte-level BPE spell each byte: printable ones as themselves, the others by characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in plain}
    return [spelled.setdefault(b, chr(256 + b - sum(p < b for p in plain))) for b in range(256)]


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """One for each worker: what it has compiled serves its later tasks."""
    return Transducer(path)


# ---- texts -----------------------------------------------------------------------------------------------------------------


class Counter:
    """Counts tokens of texts by a vocabulary, its special strings and its library's classes of characters."""

    def __init__(self, path: str, specials: list[str], classes: bytes):
        self.transducer = transducer(path)
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        longest = sorted((s.encode() for s in specials), key=lambda s: -len(s))
        self.special = re.compile(b"|".join(map(re.escape, longest))) if longest else None

    def parts(self, text: bytes) -> Iterator[bytes]:
        """Stretches between special strings, long ones cut before spaces at which a pre-token begins whatever stands around."""
        for part in self.special.split(text) if self.special else [text]:
            start = 0
            while len(part) - start > SLICE:
                cut = _CUT.search(part, start + SLICE // 2)
                if cut is None:
                    break
                yield part[start : cut.start() + 1]
                start = cut.start() + 1
            yield part[start:]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        found = np.zeros(len(texts), np.int64)
        parts, owners, held = [], [], 0
        for i, text in enumerate(texts):
            if self.special:
                found[i] += sum(1 for _ in self.special.finditer(text))
            for part in self.parts(text):
                if part:
                    parts.append(part)
                    owners.append(i)
                    if (held := held + len(part)) > SLICE:
                        self._add(found, parts, owners)
                        parts, owners, held = [], [], 0
        if parts:
            self._add(found, parts, owners)
        return found

    def _add(self, found: np.ndarray, parts: list[bytes], owners: list[int]) -> None:
        joined = b"".join(parts)
        data = np.frombuffer(joined, np.uint8)
        heads = np.cumsum([0, *map(len, parts)])[:-1]
        if joined.isascii():
            chars, places = data, None
        else:
            chars, places = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4"), np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(chars), bool)
        first[heads if places is None else np.searchsorted(places, heads)] = True
        begin = np.flatnonzero(word_starts(chars, first, self.classes))
        if places is not None:
            begin = places[begin]
        tokens = self.transducer.counts(data, begin, np.diff(begin, append=len(data)))
        np.add.at(found, owners, np.add.reduceat(tokens, np.searchsorted(begin, heads)))


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens), columns of these names replaced.

    ``path`` is a vocabulary file of the tokenizers library: byte-level BPE with the usual pre-tokens and no normalizer; others are
    an error. Special strings inside texts are one token each, as that library has it by default. A null text counts as empty: 0
    bytes, 0 tokens. Rows that repeat stay, an empty table gives an empty one. A text of any length is counted whole, a few MB at
    a time. Nothing is shuffled.
    """
    common.small_batches(docs.sparkSession)
    specials, classes = _checked(path), character_classes(path)
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    keys = docs.select(*kept).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, specials, classes)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(counter(texts), pa.int64())], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    from pyspark.sql.types import LongType, StructType

    out = StructType([*keys.fields]).add("n_bytes", LongType()).add("n_tokens", LongType())
    counted = docs.select(*kept, common.text_or_empty(text).alias("_text")).mapInArrow(common.lean(count), out)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _checked(path: str) -> list[str]:
    """The special strings of a vocabulary file that this operator can count with."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = not any(told.get(k) for k in ("truncation", "padding", "normalizer", "post_processor"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("token counts need plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in told["added_tokens"]):
        raise ValueError("token counts need special strings that stand for themselves")
    return [t["content"] for t in told["added_tokens"]]


def op13_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")
