"""Byte-level BPE over a whole corpus: each distinct word is merged once, then its ids go back to every position.

1. A task packs documents into chunks of about ``CHUNK_CHARS``. A chunk keeps the positions of its pre-tokens as one sequence
   of word numbers (frequent words have low ones), and lists each of its distinct words once.
2. Lists are dealt to buckets by a hash of the word, so all chunks' entries of a word meet in one bucket: it is merged there
   once, whatever number of chunks hold it. A chunk gives a frequent word to its bucket no more often than a rare one, so
   buckets are even.
3. Ids go back to their chunks; each chunk puts ids together by position.

Decoding gives each chunk's distinct ids as rows, joins them with the token-byte table, and puts bytes together by position.
Both ways nothing but chunks, lists of words and lists of ids moves, and nothing is kept from task to task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

CHUNK_CHARS = 1 << 21
MOST_SENT = 1_000_000  # rows of a token-byte table that is broadcast; a vocabulary has its size, whatever the corpus
ROWS_AT_ONCE = 1000


class Splitter:
    """Splits a text as ``pattern`` says, by Python's re where all letters are below U+0250, else by the regex module."""

    def __init__(self, pattern: str):
        import regex

        low = [chr(c) for c in range(0x250)]
        cls = {k: "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == k) for k in "LN"}
        spaced = pattern.replace(r"[^\s", f"[^{common.WHITE_SPACE}").replace(r"\s", f"[{common.WHITE_SPACE}]").replace(r"\S", f"[^{common.WHITE_SPACE}]")
        self.any = regex.compile(spaced).findall
        self.low = re.compile(re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\p{L}", cls["L"]).replace(r"\p{N}", cls["N"]), spaced).replace(r"\p{L}", f"[{cls['L']}]").replace(r"\p{N}", f"[{cls['N']}]")).findall
        self.is_low = re.compile(f"[\x00-{chr(0x24F)}]*").fullmatch

    def __call__(self, text: str) -> list[str]:
        return self.low(text) if self.is_low(text) else self.any(text)


class Numbers(dict):
    """Words get numbers in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Merges(dict):
    """Words as bytes -> ids as little-endian unsigned 32-bit integers, each merged when it first comes."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        self.merge = merge

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = np.asarray(self.merge(word), "<u4").tobytes()
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merger(path: str, pattern: str) -> Callable[[bytes], list[int]]:
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})._core_bpe.encode_single_piece


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a worker's memory stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte (all lowest bytes first), compressed: the high bytes are few."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


# ---- encoding -------------------------------------------------------------------------------------------------------------

_PACKED = ("bucket", "chunk", "made_of", "doc_ids", "counts", "numbers", "words", "lengths")


def _chunks(docs: DataFrame, pattern: str, buckets: int, chunk_chars: int, lists: bool) -> DataFrame:
    """Of each chunk either its lists, a row for each bucket with the numbers, bytes and lengths of its distinct words there, or
    one row with doc_ids, the number of words of each document (counts) and the sequence of word numbers (numbers).

    Sequences would be moved twice if both came from one pass, so there are two. Rows are sorted in their partitions before,
    so both passes see the same chunks; ``made_of``, a checksum of a chunk's words, tells if the input was another one.
    """
    common.small_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, first = Splitter(pattern), 0
        chunk, chars, words, doc_ids, counts, sequence = 0, 0, Numbers(), [], [], []

        def out() -> pa.RecordBatch:
            numbers = np.concatenate(sequence)
            order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
            rank = np.zeros(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            raw = [w.encode() for w in words]
            made_of = zlib.crc32(b"\0".join(raw))
            if not lists:
                rows = [(None, first + chunk, made_of, doc_ids, _packed(np.array(counts, np.int64)), _packed(rank[numbers]), None, None)]
            else:
                rows = []
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
                dealt = order[np.argsort(bucket[order], kind="stable")]  # by bucket, then by rank
                cuts = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    own = dealt[cuts[b] : cuts[b + 1]]
                    here = [raw[i] for i in own.tolist()]
                    steps = np.diff(rank[own].astype(np.int64), prepend=0)
                    rows.append((b, first + chunk, made_of, None, None, _packed(steps), zlib.compress(b"".join(here), 1), _packed(np.fromiter(map(len, here), np.int64, len(here)))))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_PACKED)

        for batch in _sliced(batches):
            first = batch.column(2)[0].as_py() << 32
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split(text)
                doc_ids.append(doc_id)
                counts.append(len(found))
                sequence.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                chars += len(text)
                if chars >= chunk_chars:
                    yield out()
                    chunk, chars, words, doc_ids, counts, sequence = chunk + 1, 0, Numbers(), [], [], []
        if doc_ids:
            yield out()

    rows = docs.select("doc_id", common.text_or_empty().alias("text"), F.spark_partition_id().alias("part")).sortWithinPartitions("doc_id", "text")
    key = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(common.lean(pack), f"bucket int, chunk long, made_of long, doc_ids array<{key}>, counts binary, numbers binary, words binary, lengths binary")


def _merged(lists: DataFrame, ranks_path: str, pattern: str, buckets: int) -> DataFrame:
    """The same rows, with words and lengths replaced by ids and how many each word has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ranks, now = merger(ranks_path, pattern), None
        known = Merges(with_ranks)
        for batch in batches:
            for start in range(batch.num_rows):
                row = batch.slice(start, 1)
                bucket, words, lengths = (row.column(c)[0].as_py() for c in (0, 6, 7))
                if bucket != now:
                    now, known = bucket, Merges(with_ranks)
                ends = np.concatenate([[0], np.cumsum(_unpacked(lengths))]).astype("<i8")
                found = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(zlib.decompress(words))]).to_pylist()
                ids = list(map(known.__getitem__, found))
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([_packed(np.frombuffer(b"".join(ids), "<u4"))], pa.binary()), pa.array([_packed(sizes)], pa.binary())], names=_PACKED)

    dealt = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(common.lean(merge), lists.schema)


def _documents(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Of one chunk's rows: its doc_ids, the place where each document's ids end, and all ids by position."""
    whole, numbers, ids, sizes = None, [], [], []
    rows = table.to_pylist()
    for row in rows:
        if row["words"] is None:
            whole = row
        else:
            numbers.append(np.cumsum(_unpacked(row["numbers"]), dtype=np.int64))
            ids.append(_unpacked(row["words"]))
            sizes.append(_unpacked(row["lengths"]))
    if whole is None or len({row["made_of"] for row in rows}) > 1:
        raise ValueError("the documents were not the same when read again; write them to a table before")
    ends = np.cumsum(_unpacked(whole["counts"]), dtype=np.int64)
    if not numbers:
        return whole["doc_ids"], np.zeros(len(ends), np.int64), np.zeros(0, np.uint32)
    flat, by_row, at = np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(numbers)
    size, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    size[at], start[at] = by_row, np.cumsum(by_row) - by_row
    sequence = _unpacked(whole["numbers"])
    length = size[sequence]
    upto = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(start[sequence] - upto[:-1], length) + np.arange(upto[-1])
    return whole["doc_ids"], upto[ends], flat[take]


def _by_chunk(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int):
    buckets = common.partitions(docs.sparkSession)
    lists, sequences = (_chunks(docs, pattern, buckets, chunk_chars, x) for x in (True, False))
    return _merged(lists, ranks_path, pattern, buckets).unionByName(sequences).groupBy("chunk")


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Ids of every document: (doc_id, ids), ids as little-endian unsigned 32-bit integers in one binary value.

    A null text counts as empty and gives no ids, as does an empty one. Rows that repeat, also with the same doc_id, give a row
    each; a null doc_id stays null. An empty table gives an empty one. Other columns of ``docs`` are not carried along. A text
    of any length is one value of one chunk, so a task must hold the longest one. ``docs`` is read twice by the same plan and
    must give the same rows to each partition both times, as tables and deterministic operations do; else the job ends with
    an error.
    """
    kind, key = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()

    def fill(table: pa.Table) -> pa.Table:
        doc_ids, ends, ids = _documents(table)
        starts = [0, *ends[:-1].tolist()]
        return pa.table({"doc_id": pa.array(doc_ids, kind), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends.tolist(), strict=True)], pa.binary())})

    return _by_chunk(docs, ranks_path, pattern, chunk_chars).applyInArrow(fill, f"doc_id {key}, ids binary")


# ---- decoding -------------------------------------------------------------------------------------------------------------


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The token-byte table: (token, bytes), as many rows as the vocabulary."""
    ranks = read_ranks(ranks_path)
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def _positions(chunk: int, doc_ids: list, ends: np.ndarray, ids: np.ndarray, kind: pa.DataType) -> pa.Table:
    """A row for each distinct id of a chunk with its place among them, and one that says which places its documents hold."""
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    seen[ids] = True
    tokens = np.flatnonzero(seen)[: len(ids)]
    places = (np.cumsum(seen, dtype=np.uint32) - np.uint32(1))[ids]
    n = len(tokens)
    none = lambda t: pa.nulls(n, t)
    head = [[chunk], [n], [None], [doc_ids], [ends.tolist()], [places.tobytes()]]
    rest = [pa.array(np.full(n, chunk), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(tokens, pa.int32()), none(pa.list_(kind)), none(pa.list_(pa.int64())), none(pa.binary())]
    return pa.table({c: pa.chunked_array([pa.array(h, r.type), r]) for c, h, r in zip(("chunk", "place", "token", "doc_ids", "ends", "places"), head, rest, strict=True)})


def _position_schema(key: str) -> str:
    return f"chunk long, place int, token int, doc_ids array<{key}>, ends array<long>, places binary"


def _joined(positions: DataFrame, ranks_path: str, read: Callable, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """Joins ids with the token-byte table, which keeps each chunk in its task, and hands each chunk's tokens and their bytes to
    ``read``, which says what becomes of a document's places among them."""
    table = token_table(positions.sparkSession, ranks_path)
    if table.count() > MOST_SENT:
        raise ValueError(f"more than {MOST_SENT} tokens")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, dict] = {}
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                c, own = int(chunk[a]), batch.slice(a, b - a)
                for i in np.flatnonzero(~own.column(3).is_null().to_numpy(zero_copy_only=False)).tolist():
                    heads[c] = {k: v[0] for k, v in own.slice(i, 1).select(["place", "doc_ids", "ends", "places"]).to_pydict().items()}
                parts.setdefault(c, []).append(own.filter(own.column(2).is_valid()).select(["place", "token", "bytes"]))
                if c in heads and sum(p.num_rows for p in parts[c]) == heads[c]["place"]:
                    head, rows = heads.pop(c), pa.Table.from_batches(parts.pop(c)).sort_by("place")
                    token, text = rows.column("token").to_pylist(), rows.column("bytes").to_pylist()
                    places, start, of = np.frombuffer(head["places"], "<u4"), 0, read(token, text)
                    out = []
                    for doc_id, end in zip(head["doc_ids"], head["ends"], strict=True):
                        out.append((doc_id, *of(places[start:end].tolist())))
                        start = end
                    columns = zip(*out, strict=True) if out else [[]] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=names)

    return positions.join(F.broadcast(table), "token", "left").select("chunk", "place", "token", "doc_ids", "ends", "places", "bytes").mapInArrow(common.lean(gather), schema)


def _of_encoded(encoded: DataFrame, ranks_path: str, read: Callable, more: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    kind, key = to_arrow_type(encoded.schema["doc_id"].dataType), encoded.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(_sliced(batches)):
            found = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            yield from _positions(n, batch.column(0).to_pylist(), np.cumsum([len(x) for x in found]), np.concatenate(found), kind).to_batches()

    positions = encoded.select("doc_id", "ids").mapInArrow(common.lean(pack), _position_schema(key))
    return _joined(positions, ranks_path, read, ["doc_id", *(m[0] for m in more)], [kind, *(m[1] for m in more)], ", ".join([f"doc_id {key}", *(f"{m[0]} {m[2]}" for m in more)]))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text_bytes) of (doc_id, ids): ids joined with the token-byte table and put together by position.

    Null ids count as none and give no bytes; ids that the table lacks are an error. Repeated rows and null doc_ids stay."""
    return _of_encoded(encoded, ranks_path, lambda token, text: lambda at: (b"".join(map(text.__getitem__, at)),), [("text_bytes", pa.binary(), "binary")])


_DIGESTS = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]


def _digest(token: list[int], text: list[bytes]) -> Callable[[list[int]], tuple[int, str, str]]:
    decimal = [b"%d," % t for t in token]
    sha = lambda parts, at, end=None: hashlib.sha256(b"".join(map(parts.__getitem__, at))[:end]).hexdigest()
    return lambda at: (len(at), sha(decimal, at, -1), sha(text, at))


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the ids)."""
    return _of_encoded(encoded, ranks_path, _digest, _DIGESTS)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """What ``digests(encode(docs))`` gives; the chunks that were encoded go on to the join without rows of documents in between."""
    kind, key = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()

    def fill(table: pa.Table) -> pa.Table:
        return _positions(table.column("chunk")[0].as_py(), *_documents(table), kind)

    positions = _by_chunk(docs, ranks_path, pattern, chunk_chars).applyInArrow(fill, _position_schema(key))
    return _joined(positions, ranks_path, _digest, ["doc_id", *(m[0] for m in _DIGESTS)], [kind, *(m[1] for m in _DIGESTS)], ", ".join([f"doc_id {key}", *(f"{m[0]} {m[2]}" for m in _DIGESTS)]))


def bpe_digests(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, chunk_chars)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(common.documents(spark, sf_dir))
