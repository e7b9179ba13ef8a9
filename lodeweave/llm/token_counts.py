"""Token counts of whole texts as a tokenizer library gives them, with overlap resynchronisation for huge documents.

A text up to `chunk_chars` long is one chunk. A longer one is encoded in chunks that overlap, with offsets. Two
neighbours are spliced at a boundary that both have and that is proven stable; if the overlap holds none, it is widened
and the chunk encoded again, at last up to the end of the text.

Why a boundary is stable: the pre-tokenizer's pattern has no match that goes from a character other than white space
into white space, and the added token holds no white space. So in front of a white space that follows another character
every encoding of a text that holds both has a boundary, what stands on its left depends on nothing beyond, and the
pattern starts afresh on its right. By the same proof a short text falls into independent segments (white space and what
follows up to the next), which repeat often: a worker encodes each distinct segment once and remembers its count.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
#: A worker forgets all segments when it holds so many: a bound on memory, not on what is counted.
MOST_SEGMENTS = 400_000
#: Characters with the Unicode property White_Space, as the library's pattern has them.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
STABLE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def spliced_ids(text: str, encode: Callable, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[int]:
    """Ids of a whole text from overlapping chunks; encode(text) gives ids and (start, end) character offsets.

    >>> spliced_ids("", lambda t: ([], []))
    []
    """
    ids: list[int] = []
    begin, skip = 0, 0  # this chunk starts at begin; what ends up to skip is already taken
    overlap = overlap_chars
    now, spans = encode(text[:chunk_chars])
    length = chunk_chars
    while True:
        end = min(len(text), begin + length)
        if end == len(text):
            return ids + [i for i, (a, _) in zip(now, spans, strict=True) if begin + a >= skip]
        start = max(begin, end - overlap)
        if start <= skip:  # the overlap has been widened to all of this chunk: make the chunk itself longer
            length *= 2
            now, spans = encode(text[begin : begin + length])
            continue
        following, its_spans = encode(text[start : start + chunk_chars])
        left = {begin + b for _, b in spans} & {begin + a for a, _ in spans}
        right = {start + a for a, _ in its_spans}
        # not the first character of the right chunk, whose left neighbour it hasn't seen, nor the end of the left one
        at = next((m.start() for m in STABLE.finditer(text, start + 1, end - 1) if m.start() in left and m.start() in right), None)
        if at is None:
            overlap *= 2
            continue
        ids += [i for i, (a, b) in zip(now, spans, strict=True) if begin + a >= skip and begin + b <= at]
        begin, skip, now, spans, length, overlap = start, at, following, its_spans, chunk_chars, overlap_chars


class Counter:
    """Counts a worker's texts; holds the tokenizer and the counts of segments seen."""

    def __init__(self, path: str, chunk_chars: int, overlap_chars: int):
        self.tokenizer = _tokenizer(path)
        self.chunk_chars, self.overlap_chars = chunk_chars, overlap_chars
        self.seen: dict[str, int] = {}

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def counts(self, texts: list[str | None]) -> list[int]:
        parts = [SEGMENT.findall(t) if t and len(t) <= self.chunk_chars else () for t in texts]
        seen = self.seen
        if len(seen) > MOST_SEGMENTS:
            seen.clear()
        new = list({s for p in parts for s in p if s not in seen})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            seen.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        get = seen.__getitem__
        return [
            sum(map(get, p)) if not t or len(t) <= self.chunk_chars else len(spliced_ids(t, self.encode, self.chunk_chars, self.overlap_chars))
            for t, p in zip(texts, parts, strict=True)
        ]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `vocabulary` is the path of a byte-level BPE tokenizer file, which each worker opens. Null and empty texts have no
    bytes and no tokens. Every row gives a row, repeated ones too; a null doc_id stays null. Other columns are ignored.
    No rows give none.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk_chars, overlap_chars)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                n = counter.counts(texts)
                n_bytes = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
