"""Byte-level BPE encoding and decoding with a file of merge ranks.

One pass over the texts, without moving them, gives each chunk of documents its distinct words and the documents as codes of
these words. Each distinct word of the corpus is then encoded once, by Spark higher-order functions: the word is an array of
byte tokens, and a fold merges, while any adjacent pair has a rank, the pair of the lowest rank. The ranks are one literal row
of the plan: a perfect hash table over the pairs of tokens. Chunks of codes and the ids of their words meet again by chunk, so no worker
holds more than one chunk. A fold copies its array at each step, so words above LONG bytes are merged by the same rule with
a heap. Decoding concatenates the tokens' binary pieces.
"""

from __future__ import annotations

import base64
import functools
import heapq
import pickle
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm._common import runs

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A chunk of documents holds about so many bytes of text.
CHUNK_BYTES = 20 << 20
#: Words of more bytes are merged with a heap.
LONG = 256
#: White space and what follows up to the next: no word of the pattern goes from another character into white space, so
#: words can be sought segment by segment, and each distinct segment once.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Texts that need SEGMENT; in all others a segment is a piece between single spaces or line ends, with the one before it.
_ODD = re.compile(f"[{_SPACE.replace('t-', 't\\x0b-').replace(' ', '')}]|[ \\n][ \\n]|\\A[ \\n]| \\Z")
#: Groups and slots of the hash table: primes. The table is part of the plan, which the driver holds, so it is small.
_GROUPS, _SLOTS = 32_749, 131_101
#: A word in a chunk is one number: task, chunk of the task, code of the word.
_CHUNKS, _CODES = 14, 27


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots holding pair * 65536 + rank (or -1), and displacements: pair (a, b) is p = a * 65536 + b, and sits in slot
    (p xor displacement[p mod GROUPS]) mod SLOTS."""
    known = ranks(path)
    if max(known.values(), default=0) >= 1 << 16:
        raise ValueError("ranks of 65536 and more are not supported")
    pairs, merged = array("q"), array("q")
    for token, rank in known.items():
        for cut in range(1, len(token)):
            a, b = known.get(token[:cut]), known.get(token[cut:])
            if a is not None and b is not None:
                pairs.append(a << 16 | b)
                merged.append(rank)
    if len(pairs) > 0.95 * _SLOTS:
        raise ValueError("too many pairs for the table")
    key = np.frombuffer(pairs, np.int64)
    cell = key << 16 | np.frombuffer(merged, np.int64)
    group = key % _GROUPS
    order = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=_GROUPS)
    begin = np.concatenate([[0], np.cumsum(size)])
    slots, moved = np.full(_SLOTS, -1, np.int64), np.zeros(_GROUPS, np.int64)
    draw = np.random.default_rng(1)
    for g in np.argsort(-size, kind="stable"):
        own = order[begin[g] : begin[g + 1]]
        while len(own):
            d = int(draw.integers(0, 1 << 31))
            at = (key[own] ^ d) % _SLOTS
            if (slots[at] < 0).all() and len(np.unique(at)) == len(at):
                slots[at], moved[g] = cell[own], d
                break
    return slots, moved.astype(np.int32)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _row(spark: SparkSession, **arrays: pa.Array) -> Column:
    """A struct of constant arrays, by a local row: each description of a plan prints literals in full, and such a row never.

    Spark admits no subquery inside a higher-order function, so it is selected as a column first; as it is used once there,
    the optimiser puts it back into its place, and no row carries it.
    """
    return spark.createDataFrame(pa.table({k: pa.array([x], pa.list_(x.type)) for k, x in arrays.items()})).select(F.struct(*arrays)).scalar()


def rank_table(spark: SparkSession, path: str) -> Column:
    """The merge ranks that encoded_word looks up, for a column of a select of its own."""
    slots, moved = pair_table(path)
    known = ranks(path)
    return _row(spark, slots=pa.array(slots), moved=pa.array(moved), bytes=pa.array([known[bytes([b])] for b in range(256)], pa.int32()))


def encoded_word(word: Column, table: Column) -> Column:
    """The ids of a word, by folding ranked merges over its bytes; null for null, no ids for the empty word."""

    def rank(t: Column, a: Column, b: Column) -> Column:
        pair = a * F.lit(65536).cast("long") + b
        at = (pair.bitwiseXOR(F.get(t["moved"], (pair % _GROUPS).cast("int")).cast("long")) % _SLOTS).cast("int")
        # the cell less the pair's place is the rank, if the cell is the pair's
        rest = F.get(t["slots"], at) - pair * F.lit(65536).cast("long")
        return F.when(rest.between(0, 65535), rest.cast("int"))

    def merged(t: Column) -> Callable[[Column, Column], Column]:
        def step(state: Column, _: Column) -> Column:
            ids, between = state["ids"], state["ranks"]

            def at(low: Column, i: Column) -> Column:
                # the i-th pair (from 1) becomes one token: places from 0, so its left token is at i - 1, its right one at i
                put = F.transform(ids, lambda x, k: F.when(k == i - 1, low).otherwise(x))
                beside = F.transform(between, lambda r, k: F.when(k == i - 2, rank(t, F.get(ids, i - 2), low)).when(k == i, rank(t, low, F.get(ids, i + 1))).otherwise(r))
                return F.struct(F.filter(put, lambda _, k: k != i).alias("ids"), F.filter(beside, lambda _, k: k != i - 1).alias("ranks"))

            return _let(
                F.array_min(between),
                lambda low: F.when(low.isNull(), state).otherwise(_let(F.array_position(between, low).cast("int"), lambda i: at(low, i))),
            )

        return step

    def fold(t: Column) -> Column:
        # as ISO-8859-1 each byte is a character
        in_bytes = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(t["bytes"], F.ascii(c)))
        begin = _let(in_bytes, lambda ids: F.struct(ids.alias("ids"), F.transform(F.slice(ids, 2, F.size(ids)), lambda b, k: rank(t, F.get(ids, k), b)).alias("ranks")))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1))), begin, merged(t))["ids"]

    return F.when(F.octet_length(word) > 0, _let(table, fold)).when(word.isNotNull(), F.array().cast("array<int>"))


def merged_word(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The ids of a word by the same rule: a linked list of pieces and a heap of (rank, place), the leftmost first on ties."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(range(1, n + 1))

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := known.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:  # one of the two has been merged since
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [known[word[i : end[i]]] for i in range(n) if alive[i]]


class _Codes(dict):
    """Of a piece of text, the codes of its words in the chunk, as bytes of int32."""

    def __init__(self, find: Callable, lead: str, words: dict[str, int]):
        self.find, self.lead, self.words = find, lead, words

    def __missing__(self, piece: str) -> bytes:
        words = self.words
        found = self.find(piece if piece[:1] == "\n" else self.lead + piece)
        out = self[piece] = np.array([words.setdefault(w, len(words)) for w in found], np.int32).tobytes()
        return out


@functools.cache
def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _planes(numbers: np.ndarray) -> bytes:
    """int32 numbers, their bytes sorted by place, compressed."""
    return _zstd().compress(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unplaned(data: bytes, n: int) -> np.ndarray:
    raw = _zstd().decompress(data, decompressed_size=4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.int32).ravel()


def _coded(docs: DataFrame, pattern: str, chunk_bytes: int) -> DataFrame:
    """Rows of a chunk: documents (doc_ids, n_bytes, n_words, codes of their words) or, once, its words in order of code."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        chunk, size, held = TaskContext.get().partitionId() << _CHUNKS, 0, 0
        words: dict[str, int] = {}
        first, inner, segments = (_Codes(find, lead, words) for lead in ("", " ", ""))
        ids, n_bytes, parts = [], [], []
        names = ["chunk", "doc_ids", "n_bytes", "n_words", "codes", "words"]

        def documents() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            n_words = np.array([len(p) // 4 for p in parts], np.int64)
            codes = np.frombuffer(b"".join(parts), np.int32)
            of = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), x) for x in (own, pa.array(n_bytes, pa.int64()), pa.array(n_words))]
            out = pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *of, pa.array([_planes(codes)], pa.binary()), pa.nulls(1, pa.binary())], names)
            for x in (ids, n_bytes, parts):
                x.clear()
            return out

        def vocabulary() -> pa.RecordBatch:
            own = [w.encode() for w in words]
            text = b"".join(own)
            out = [len(own), len(text), _planes(np.array([len(w) for w in own], np.int32)), _zstd().compress(text, asbytes=True)]
            for x in (words, first, inner, segments):
                x.clear()
            none = [pa.nulls(1, t) for t in (pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *none, pa.array([pickle.dumps(out)], pa.binary())], names)

        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                ids.append(batch.column(0).slice(at, 256))
                for text in batch.column(1).slice(at, 256).to_pylist():
                    text = text or ""
                    n_bytes.append(len(text.encode()))
                    if _ODD.search(text):
                        codes = b"".join(map(segments.__getitem__, SEGMENT.findall(text)))
                    elif text:
                        start, *rest = text.replace("\n", " \n").split(" ")
                        codes = first[start] + b"".join(map(inner.__getitem__, rest))
                    else:
                        codes = b""
                    parts.append(codes)
                    held += len(codes)
                    size += n_bytes[-1]
                if held > 4 << 20 or size > chunk_bytes:
                    yield documents()
                    held = 0
                if size > chunk_bytes:
                    yield vocabulary()
                    chunk, size = chunk + 1, 0
        if ids:
            yield documents()
        if size or words:
            yield vocabulary()

    schema = f"chunk long, doc_ids array<{kind}>, n_bytes array<long>, n_words array<long>, codes binary, words binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, ids array<int>, as the library would encode the text without special tokens.

    Null and empty texts have no ids. Every row gives a row, repeated ones too; a null doc_id stays null. Other columns
    are ignored. No rows give none. The ranks' file needs all 256 bytes and ranks below 65536; no match of the pattern may go
    from another character into white space. A task's rows must come in the same order if it runs again, as those of files do.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    dealt = _coded(docs, pattern, chunk_bytes).repartition("chunk")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column("words")[k].as_py()
                if data is None:
                    continue
                chunk = batch.column("chunk")[k].as_py()
                n, size, lengths, text = pickle.loads(data)
                ends = np.concatenate([[0], np.cumsum(_unplaned(lengths, n))]).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends), _zstd().decompress(text, decompressed_size=size)])
                for at in range(0, len(words), 50_000):
                    part = words.slice(at, 50_000)
                    yield pa.RecordBatch.from_arrays([part, pa.array((chunk << _CODES) + np.arange(at, at + len(part)))], ["word", "at"])

    # all columns of `dealt`, so that both its readers share one exchange
    words = dealt.mapInArrow(distinct, "word string, at long")
    # rows themselves are dealt out: a partial list a word and chunk would be larger
    known = words.repartition("word").groupBy("word").agg(F.collect_list("at").alias("at"))
    short = F.octet_length("word") <= LONG
    known = known.select("*", rank_table(docs.sparkSession, path).alias("table"))
    known = known.select("at", F.when(short, encoded_word(F.col("word"), F.col("table"))).alias("ids"), F.when(~short, F.col("word")).alias("word"))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk, the codes of words, how many ids they have, and the ids."""
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            at, of, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            begin = np.cumsum(n) - n
            word = np.repeat(np.arange(len(n)), of)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order] >> _CODES, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                some = order[a:b]
                w = word[some]
                step = np.diff(at[some] & ((1 << _CODES) - 1), prepend=0)
                own = ids[runs(begin[w], n[w])].astype(np.uint16)
                # sorted codes by their differences, which are small
                data = pickle.dumps((len(step), len(own), _planes(step), _planes(n[w]), _zstd().compress(own.tobytes(), asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array([int(at[some[0]]) >> _CODES], pa.int64()), pa.array([data], pa.binary())], ["chunk", "held"])
            held.clear()

        for batch in batches:
            at, ids, long = batch.column(0), batch.column(1), batch.column(2)
            if long.null_count < len(long):
                vocabulary = ranks(path)
                ids = pa.array([i if w is None else merged_word(w.encode(), vocabulary) for i, w in zip(ids.to_pylist(), long.to_pylist(), strict=True)], ids.type)
            counts = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (at, ids)]
            held.append((at.flatten().to_numpy(), counts[0], counts[1], ids.flatten().to_numpy(zero_copy_only=False)))
            size += counts[0].sum() + counts[1].sum()
            if size > 3_000_000:
                yield from rows()
                size = 0
        if held:
            yield from rows()

    looked_up = known.mapInArrow(lookup, "chunk long, held binary")

    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, n_ids, step, n, ids = pickle.loads(data)
        return np.cumsum(_unplaned(step, words)), _unplaned(n, words), np.frombuffer(_zstd().decompress(ids, decompressed_size=2 * n_ids, asbytes=True), np.uint16)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in right.column("held").to_pylist()]
        codes, n, flat = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        begin, size = (np.zeros(len(codes), np.int64) for _ in range(2))
        begin[codes], size[codes] = np.cumsum(n, dtype=np.int64) - n, n
        out = []
        for k in range(left.num_rows):
            doc_ids = left.column("doc_ids")[k].values
            if doc_ids is None:  # the row of words
                continue
            n_bytes, n_words = left.column("n_bytes")[k].values, left.column("n_words")[k].values.to_numpy()
            words = _unplaned(left.column("codes")[k].as_py(), int(n_words.sum()))
            sizes = size[words]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n_words)])]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[runs(begin[words], sizes)].astype(np.int32)))
            out.append(pa.table({"doc_id": doc_ids, "n_bytes": n_bytes, "ids": ids}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.nulls(0, id_type(left)), "n_bytes": pa.nulls(0, pa.int64()), "ids": pa.nulls(0, pa.list_(pa.int32()))})

    def id_type(left: pa.Table) -> pa.DataType:
        return left.schema.field("doc_ids").type.value_type

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(apply, f"doc_id {kind}, n_bytes long, ids array<int>")


def piece_table(spark: SparkSession, vocabulary: str | None = None) -> Column:
    """The pieces that `decoded` looks up, for a column of a select of its own."""
    known = ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    pieces = [b""] * (max(known.values(), default=-1) + 1)
    for token, rank in known.items():
        pieces[rank] = token
    return _row(spark, pieces=pa.array(pieces, pa.binary()))


def decoded(ids: Column, table: Column) -> Column:
    """The bytes of ids: their pieces, concatenated; null for null."""
    # a binary piece goes through a string type as it is: no character is decoded
    return _let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t["pieces"], i).cast("string")), "").cast("binary"))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    out = encode(docs, vocabulary)
    return out.select("*", piece_table(docs.sparkSession, vocabulary).alias("table")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), F.col("table")), 256).alias("decoded_sha256"),
    )
