"""Alignment of the tokens of two tokenizers, and how often pairs of ids are linked in all documents.

The B tokens of a text are a static index of intervals: their ends, sorted. The range of each A token stabs it by
bisection and gets the list of B tokens that it overlaps. A gap between B tokens that no such list spans is a boundary of
both, so it ends a group.

Segments. Neither tokenizer joins a character other than white space with a space behind it: the pattern of A has no
match that goes on there, and no piece of B has a space behind another character. So a text falls into segments (a space
with what follows, up to the next) that are encoded alone as within the text, and every link and group lies in one. A
worker aligns each distinct segment once. `align` checks the claim about the pieces; texts with a segment that the
tokenizers don't give back are encoded whole.

Corpus-wide counts. A document's sums need the counts of pairs over all documents. Documents are read once: a chunk of
them keeps its distinct pairs, and its documents as codes of distinct segments. Pairs are counted by id pair, joined back
to the chunks that hold them (a common pair comes once a chunk, not once a document), and each chunk meets its own pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm._common import runs, written
from lodeweave.llm.token_counts import SPACE

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A chunk of documents ends when its texts have so many characters, or when the worker holds so many segments, which it
#: then forgets: bounds on memory, not on what is counted.
CHUNK_CHARS = 1 << 24
MOST_SEGMENTS = 400_000
#: Before a space that follows a character other than white space; never before trailing spaces, which B can't be given alone.
CUT = re.compile(f"(?<=[^{SPACE}])(?= +[^ ])")
SPACE_PIECE = "▁"


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens that cover the same bytes without gaps: the first B token that each A token overlaps, the one behind its last, and the B tokens that end groups.

    >>> [x.tolist() for x in overlaps(np.array([3, 5, 6]), np.array([2, 5, 6]))]
    [[0, 1, 2], [2, 2, 3], [1, 2]]
    """
    starts = [np.concatenate([[0], x[:-1]]) for x in (a_ends, b_ends)]
    low, high = np.searchsorted(b_ends, starts[0], "right"), np.searchsorted(starts[1], a_ends, "left")
    # the gaps behind the B tokens low to high - 2 lie inside the A token: it spans them
    spanned = np.zeros(len(b_ends) + 1, np.int64)
    np.add.at(spanned, low, 1)
    np.add.at(spanned, high - 1, -1)
    return low, high, np.flatnonzero(np.cumsum(spanned[:-1]) == 0)


class Aligner:
    """A worker's tokenizers, and the distinct segments it has aligned, by number."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = byte_of_character()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else b""
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)]
        #: whether texts may be cut: no piece holds a space behind another character
        self.cuts = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces)
        self.sizes = [np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b)]
        #: ids as text, each with what may follow it: a comma, the bar between A and B, the end of a group
        self.shown = np.array([[f"{i}{mark}" for mark in ",|;"] for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self.clear()

    def clear(self) -> None:
        #: a segment's number; below 0 where A or B doesn't give its bytes back
        self.seen: dict[str, int] = {}
        #: by number: the groups as text; n_a, n_b, n_groups, n_links; where the links end, each a * 2^32 + b
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)
        self.links = np.zeros(0, np.int64)

    def segments(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def learn(self, segments: list[str]) -> None:
        """Aligns segments, each of which begins with the space that B adds itself."""
        facts, links = [self.facts], [self.links]
        for at in range(0, len(segments), 4096):
            some = segments[at : at + 4096]
            a = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)]
            b = self.b.encode([s[1:] for s in some], num_threads=1)
            good = self.given_back(some, a, b)
            self.seen.update((s, -1) for s, ok in zip(some, good, strict=True) if not ok)
            kept = [(s, x, y) for s, x, y, ok in zip(some, a, b, good, strict=True) if ok]
            if kept:
                some, a, b = zip(*kept, strict=True)
                self.seen.update(zip(some, range(len(self.groups), len(self.groups) + len(some)), strict=True))
                found = self.aligned(a, b)
                facts.append(found[0])
                links.append(found[1])
                self.groups += found[2]
        self.facts, self.links = np.concatenate(facts), np.concatenate(links)

    def given_back(self, segments: list[str], a: list, b: list) -> list[bool]:
        """Whether the tokens of each segment have its bytes; those of all segments are looked at first."""
        data = [s.encode() for s in segments]
        tables = ((self.bytes_a.__getitem__, a), (self.bytes_b.__getitem__, b))
        if all(b"".join(map(of, itertools.chain.from_iterable(ids))) == b"".join(data) for of, ids in tables):
            size = np.fromiter(map(len, data), np.int64, len(data))
            for sizes, ids in zip(self.sizes, (a, b), strict=True):
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate([[0], np.cumsum(sizes[np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum()))])])
                if not np.array_equal(flat[np.cumsum(n)], np.cumsum(size)):
                    break
            else:
                return [True] * len(data)
        return [all(b"".join(map(of, ids[k])) == d for of, ids in tables) for k, d in enumerate(data)]

    def aligned(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Facts, links and groups of segments, given the ids of each; all are one row of bytes, so one index serves them."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        low, high, last = overlaps(np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b]))
        links = np.repeat(ids_a, high - low) << 32 | ids_b[runs(low, high - low)]
        # a token's group; groups and links of each segment
        group_b = np.searchsorted(last, np.arange(len(ids_b)))
        group_a = group_b[high - 1]
        of_a, of_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        n_groups = np.bincount(of_b[last], minlength=len(n_b))
        n_links = np.bincount(of_a, high - low, len(n_a)).astype(np.int64)
        # what follows each token: 0 within a list, 1 behind a group's A tokens, 2 behind its B tokens
        end_a, end_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        shown = np.concatenate([self.shown[ids_a, end_a.astype(int)], self.shown[ids_b, end_b * 2]])[order]
        ends = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(shown[x:y])[:-1] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return np.column_stack([n_a, n_b, n_groups, n_links]), links, groups

    def documents(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's segments; none where it has no tokens."""
        parts = [self.segments(" " + t) if t else [] for t in texts]
        seen = self.seen
        self.learn(list({s for p in parts for s in p if s not in seen}))
        found = [list(map(seen.__getitem__, p)) for p in parts]
        whole = {k: " " + texts[k] for k, p in enumerate(found) if p and min(p) < 0}
        self.learn([t for t in set(whole.values()) if t not in seen])
        for k, t in whole.items():
            found[k] = [seen[t]] if seen[t] >= 0 else []
        return found


class Chunk:
    """How often a chunk's documents hold each of the worker's segments."""

    def __init__(self):
        self.times = np.zeros(0, np.int64)
        self.chars = 0

    def put(self, parts: list[list[int]], aligner: Aligner) -> Iterator[tuple]:
        """Per document: n_a, n_b, n_groups, n_links, groups_sha256, numbers of its distinct segments, how often it holds each."""
        self.times = np.concatenate([self.times, np.zeros(len(aligner.groups) - len(self.times), np.int64)])
        text = aligner.groups.__getitem__
        for part in parts:
            if not part:
                yield 0, 0, 0, 0, "", b"", b""
                continue
            held = np.array(part, np.int64)
            codes, times = np.unique(held, return_counts=True)
            self.times[codes] += times
            digest = hashlib.sha256(";".join(map(text, part)).encode()).hexdigest()
            yield *aligner.facts[held].sum(0).tolist(), digest, codes.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()

    def pairs(self, aligner: Aligner) -> tuple:
        """Distinct pairs (a, b, number of links); the chunk's segments by number, and each as a run (end, places) of pairs."""
        used = np.flatnonzero(self.times)
        size = aligner.facts[used, 3]
        begin = np.cumsum(aligner.facts[:, 3]) - aligner.facts[:, 3]
        links = aligner.links[runs(begin[used], size)]
        pairs, places = np.unique(links, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, places, np.repeat(self.times[used], size))
        return (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), n, used.astype(np.uint32).tobytes(), np.cumsum(size).tobytes(), places.astype(np.uint32).tobytes()


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PACKED = "segments binary, times binary, ends binary, places binary"


def chunks(docs: DataFrame, path_a: str, path_b: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row a document with its packed segments, and at the end of each chunk one with the chunk's pairs (doc columns null)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, is_doc boolean, doc_id {kind}, {_DOC}, {_PACKED}, a array<int>, b array<int>, n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        number, chunk, target = TaskContext.get().partitionId() << 24, Chunk(), None

        def batch_of(columns: dict, rows: int) -> pa.RecordBatch:
            columns = {"chunk": pa.array([number] * rows, pa.int64())} | columns
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in target], schema=target)

        def close() -> pa.RecordBatch:
            a, b, n, used, ends, places = chunk.pairs(aligner)
            lists = {"a": (a, pa.int32()), "b": (b, pa.int32()), "n": (n, pa.int64())}
            columns = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for k, (v, t) in lists.items()}
            return batch_of({"is_doc": pa.array([False]), "segments": pa.array([used], pa.binary()), "ends": pa.array([ends], pa.binary()), "places": pa.array([places], pa.binary())} | columns, 1)

        for batch in batches:
            if target is None:
                flat = [("chunk", pa.int64()), ("is_doc", pa.bool_()), ("doc_id", batch.schema.field(0).type)]
                flat += [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())]
                flat += [(c, pa.binary()) for c in ("segments", "times", "ends", "places")]
                target = pa.schema([*flat, ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                rows = list(chunk.put(aligner.documents(texts), aligner))
                names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "segments", "times")
                columns = {c: pa.array(v, target.field(c).type) for c, v in zip(names, zip(*rows, strict=True), strict=True)}
                yield batch_of({"is_doc": pa.array([True] * len(texts)), "doc_id": part.column(0)} | columns, len(texts))
                chunk.chars += sum(len(t or "") for t in texts)
                full = len(aligner.seen) >= MOST_SEGMENTS
                if chunk.chars >= chunk_chars or full:
                    yield close()
                    number, chunk = number + 1, Chunk()
                if full:
                    aligner.clear()
        if chunk.chars:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's documents with n_best and count_sum; pairs has place, count and best of each of its pairs."""
    own = docs.filter(pa.compute.invert(docs["is_doc"]))
    docs = docs.filter(docs["is_doc"])
    place = pairs["place"].to_numpy()
    used, by_segment = np.zeros(0, np.uint32), np.zeros((2, 0), np.int64)
    if own.num_rows:
        used, ends, places = (np.frombuffer(own[c][0].as_py(), t) for c, t in (("segments", np.uint32), ("ends", np.int64), ("places", np.uint32)))
        value = np.zeros((2, len(place)), np.int64)
        value[0, place] = pairs["best"].to_numpy()
        value[1, place] = pairs["count"].to_numpy()
        upto = np.zeros((2, len(places) + 1), np.int64)
        np.cumsum(value[:, places], axis=1, out=upto[:, 1:])
        by_segment = np.diff(upto[:, np.concatenate([[0], ends])], axis=1)
    sums = [
        by_segment[:, np.searchsorted(used, np.frombuffer(s, np.uint32))] @ np.frombuffer(t, np.uint32).astype(np.int64) if s else (0, 0)
        for s, t in zip(docs["segments"].to_pylist(), docs["times"].to_pylist(), strict=True)
    ]
    best, count = (pa.array([int(x[k]) for x in sums], pa.int64()) for k in range(2))
    return pa.table([docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [best, count, docs["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the rows of `chunks`: each chunk's pairs (chunk, place, a, b, n), and the corpus-wide counts (a, b, count, best).

    best is 1 where no pair of the same B id has more links, else 0. The table joined by broadcast has a row for each B id
    at most: its size is bounded by B's vocabulary.
    """
    links = table.where("NOT is_doc").select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p")).select("chunk", "place", "p.*")
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return links, counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level tokenizer file) encodes a space and the text, B (a piece model that adds the space itself) the text.
    n_links counts the pairs of an A and a B token that share bytes; count_sum adds up, over them, how many links of all
    documents have the same two ids, and n_best says for how many of them no A id has more with the same B id. Null and
    empty texts, and those that A or B doesn't give back byte by byte, have no tokens: zeros and ''. Each row gives a
    row, repeated ones and those with a null id too; other columns are ignored; no rows give none. Workers open both
    files at the paths given.
    """
    path_a, path_b = vocabulary_a or public_tokenizers.path(VOCABULARY_A), vocabulary_b or public_tokenizers.path(VOCABULARY_B)
    table = written(chunks(docs, path_a, path_b, chunk_chars), "chunks")
    links, counts = pair_counts(table)
    found = links.select("chunk", "place", "a", "b").join(counts, ["a", "b"]).select(F.col("chunk").alias("of"), "place", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return table.drop("a", "b", "n").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_scored, out)
