"""Token files as directly addressable codes.

Ids are cut into chunks of eight bits. Level 0 holds the low chunk of every id, level 1 the next chunk of the ids that
need one, and so on. Each level carries a bitmap that says which of its entries continue on the next level, and a rank
directory (ones before every 512th entry), so entry ``i`` is found by following ranks: no block is decoded.

A segment is the unit of storage: some ten thousands of ids of whole documents, in ascending ``doc_id`` order. A file
set is a table of segments, written by the executors in range partitions of ``doc_id``.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import common

MAGIC = b"DAC1"
RANK_STEP = 512
END_ID = 1
SEGMENT_TOKENS = 1 << 18
CACHE_WORDS = 250_000

SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("codes", T.BinaryType()),
    ]
)


# ---- the format -----------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """Encode unsigned ids (below 2**32) as levels of chunks, bitmaps and rank directories."""
    values = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = values > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.concatenate(([0], np.cumsum(more, dtype=np.uint32)))[: len(values) + 1 : RANK_STEP].astype("<u4")
        levels.append(struct.pack("<III", len(values), len(bits), len(ones)) + (values & 0xFF).astype(np.uint8).tobytes() + bits + ones.tobytes())
        values = values[more] >> 8
        if not len(values):
            return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class Codes:
    """A packed segment: ``codes[i]`` reads one id, ``codes.read(a, b)`` some in a row, ``codes.all()`` every id."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(blob[4]):
            n, n_bits, n_ones = struct.unpack_from("<III", blob, at)
            at += 12
            chunks = np.frombuffer(blob, np.uint8, n, at)
            bits = np.frombuffer(blob, np.uint8, n_bits, at + n)
            ones = np.frombuffer(blob, "<u4", n_ones, at + n + n_bits)
            self.levels.append((chunks, bits, ones))
            at += n + n_bits + 4 * n_ones

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return int(self.read(i, i + 1)[0])

    def _rank(self, level: int, i: int) -> int:
        """How many of a level's entries before entry i continue: the directory, and the bits since its last step."""
        _, bits, ones = self.levels[level]
        start, end = i // RANK_STEP, i >> 3
        found = int(ones[start]) + int(np.bitwise_count(bits[start * RANK_STEP >> 3 : end]).sum())
        return found + int(bits[end] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else found

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1: at each level those entries alone, whose place on the next level their rank tells."""
        values, where, n = np.zeros(b - a, np.uint32), slice(None), b - a
        for level, (chunks, bits, _) in enumerate(self.levels):
            values[where] |= chunks[a : a + n].astype(np.uint32) << np.uint32(8 * level)
            more = np.flatnonzero(np.unpackbits(bits[a >> 3 : a + n + 7 >> 3], bitorder="little")[a & 7 :][:n])
            if not len(more):
                break
            where = more if level == 0 else where[more]
            a, n = self._rank(level, a), len(more)
        return values

    def all(self) -> np.ndarray:
        values = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= values << np.uint32(8)
            values = here
        return values


# ---- the tokenizer ----------------------------------------------------------------------------------------------------

_WORD_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """A word-end BPE of the tokenizers library, one distinct word at a time.

    White space always ends a word there, so a text's ids are its words' ids joined. The library's model merges every word.
    Of words of letters that are below U+0250, in lower case too, what comes before it (lower case, splitting, bytes as
    letters) is done here; all other words take the library's whole way. Words seen are kept in two generations of up to
    ``CACHE_WORDS``, so frequent ones stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: 256 + i for i, b in enumerate(others)}  # bytes that stand for themselves are left out
        low = [chr(c) for c in range(0x250)]
        letters = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "L")
        numbers = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "N")
        spaces = "\\t-\\r \x85\xa0"
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall
        # letters whose lower case is not below U+0250 as well, like schwa and dotted I, take the library
        self.simple = re.compile(f"[{''.join(re.escape(c) for c in low if max(map(ord, c.lower())) < 0x250)}]*").fullmatch
        # what str.split() takes for white space besides the six characters that end a word
        self.odd_spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and not 9 <= ord(c) <= 13 and c != " "]
        self.words = Words(self.word, {})

    def word(self, w: str) -> bytes:
        if "<|" in w or not self.simple(w):
            return np.asarray(self.whole.encode(w, add_special_tokens=False).ids, "<u2").tobytes()
        ids = [t.id for p in self.pieces(w.lower()) for t in self.merge(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.shown))]
        return array("H", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 16-bit integers."""
        if len(self.words) > CACHE_WORDS:
            self.words.before = {}
            self.words = Words(self.word, self.words)
        found = re.findall(common.WORD, text) if any(c in text for c in self.odd_spaces) else text.split()
        return b"".join(map(self.words.__getitem__, found))


class Words(dict):
    """Words -> ids as bytes; a new one comes from the words before, or is encoded."""

    def __init__(self, encode: Callable[[str], bytes], before: dict[str, bytes]):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.before.get(word) or self.encode(word)
        return ids


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _WORD_TOKENIZERS:
        _WORD_TOKENIZERS[path] = WordTokenizer(path)
    return _WORD_TOKENIZERS[path]


# ---- writing and reading ------------------------------------------------------------------------------------------------


def write_segments(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and store segments in ascending doc_id order; returns the stored table.

    Each document's ids are followed by ``END_ID``. A null text counts as empty, equal doc_ids are ordered by text,
    a null doc_id comes first; doc_ids that are no whole numbers are an error. An empty table gives an empty one, repeated rows
    are documents of their own, and only doc_id and text are kept. A text of any length is encoded whole. The sort is a range partitioning, so no task holds more than its range.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, start = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.asarray([END_ID], "<u2").tobytes()
        ids: list[bytes] = []
        docs_here: list[int | None] = []
        counts: list[int] = []
        size = 0

        def segment() -> pa.RecordBatch:
            packed = pack(np.frombuffer(b"".join(ids), "<u2"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([docs_here], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                names=SEGMENTS.names,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = tokenizer.encode(text) + end
                ids.append(got)
                docs_here.append(doc_id)
                counts.append(len(got) // 2)
                size += counts[-1]
                if size >= SEGMENT_TOKENS:
                    yield segment()
                    start, size = start + size, 0
                    ids, docs_here, counts = [], [], []
        if ids:
            yield segment()

    common.small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).repartitionByRange(common.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.staged(ordered.mapInArrow(common.lean(encode), SEGMENTS), "dac-segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document of a stored table: doc_id, start (ids before it in the whole set), n_tokens, ids_crc32.

    Each document's ids are read by their place in its segment, through the rank directories; segments are not decoded.
    Only the totals per partition are added up in one place; their number is that of the shuffle partitions.
    """
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_part"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["codes"])
                counts = np.asarray(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(codes.read(a, b).astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["part_start"] + row["before_part"], pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = segments.join(F.broadcast(starts), "part").select("part_start", "before_part", "doc_ids", "doc_tokens", "codes")
    return rows.mapInArrow(common.lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens (with the end id), ids_crc32."""
    import public_tokenizers

    return read_segments(write_segments(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
