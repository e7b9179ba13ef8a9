"""Fill-in-the-middle texts by overlapping chunks.

A text falls into tokens: white space with what follows it up to the next. A token ends where a character other than
white space stands before white space, and at the end of the text; that is told by adjacent characters alone. So texts
are cut into chunks that overlap by one byte, tokens that end in each are counted for all chunks of a block at once,
prefix sums over the chunks of a text give its number of tokens and route the ranks of both cuts to the chunks that own
them, and only these are scanned again. Bytes do as well as characters: white space is ASCII, and a byte of a longer
character never looks like it.

No row leaves its task before it is done: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm._common import runs

CHUNK_BYTES = 2048
#: Chunks counted at once: bounds the arrays that a task holds beside its texts.
BLOCK_CHUNKS = 2048
#: Texts are taken in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 22
#: The characters that part tokens, and the marks of the three parts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def ends(data: np.ndarray, begin: int, end: int, last: np.ndarray) -> np.ndarray:
    """Whether a token ends at each byte from begin to end; `last` holds the last bytes of texts, in order."""
    seen = SPACE[data[begin : end + 1]]  # one byte more than the chunk: the overlap
    if len(seen) == end - begin:
        seen = np.append(seen, True)
    out = ~seen[:-1] & seen[1:]
    out[last[np.searchsorted(last, begin) : np.searchsorted(last, end)] - begin] = True
    return out


def counted(data: np.ndarray, offsets: np.ndarray, chunk_bytes: int) -> tuple[np.ndarray, ...]:
    """For texts at the offsets in data: per chunk its begin and end, tokens that end and characters that begin in it; the chunks of text i are those from owner[i] to owner[i + 1]; last bytes of texts."""
    size = np.diff(offsets)
    pieces = -(-size // chunk_bytes)
    owner = np.concatenate([[0], np.cumsum(pieces)])
    begin = np.repeat(offsets[:-1], pieces) + runs(np.zeros(len(pieces), np.int64), pieces) * chunk_bytes
    end = np.minimum(begin + chunk_bytes, np.repeat(offsets[1:], pieces))
    last = offsets[1:][size > 0] - 1
    tokens, chars = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    for a in range(0, len(begin), BLOCK_CHUNKS):
        b = min(a + BLOCK_CHUNKS, len(begin))
        at = begin[a:b] - begin[a]
        tokens[a:b] = np.add.reduceat(ends(data, begin[a], end[b - 1], last), at, dtype=np.int64)
        chars[a:b] = np.add.reduceat((data[begin[a] : end[b - 1]] & 0xC0) != 0x80, at, dtype=np.int64)
    return begin, end, tokens, chars, owner, last


def cuts(data: np.ndarray, offsets: np.ndarray, ranks, chunk_bytes: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, byte of each cut, characters before it). ranks(tokens) gives a row of ranks for each text.

    A cut of rank r lies behind the r-th token of its text, that of rank 0 at the text's begin.
    """
    begin, end, tokens, chars, owner, last = counted(data, offsets, chunk_bytes)
    upto, chars_upto = (np.concatenate([[0], np.cumsum(x)]) for x in (tokens, chars))
    n = upto[owner[1:]] - upto[owner[:-1]]
    wanted = ranks(n)
    place = np.repeat(offsets[:-1, None], wanted.shape[1], 1)
    before = np.zeros(wanted.shape, np.int64)
    texts, which = np.nonzero(wanted)
    target = upto[owner[texts]] + wanted[texts, which]
    routed = np.searchsorted(upto, target) - 1  # the first chunk up to whose end there are so many
    for i, k, t, c in zip(texts.tolist(), which.tolist(), target.tolist(), routed.tolist(), strict=True):
        b, e = begin[c], end[c]
        to = b + np.flatnonzero(ends(data, b, e, last))[t - upto[c] - 1] + 1
        place[i, k] = to
        before[i, k] = chars_upto[c] - chars_upto[owner[i]] + np.count_nonzero((data[b:to] & 0xC0) != 0x80)
    return n, place, before


def draws(doc_id, seed: int) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of seed and id as numbers; a null id is an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[at : at + 8], 16) for at in (0, 8, 16, 24)]


def _rows(ids: list, texts: pa.Array, seed: int, rate: int, spm_rate: int, chunk_bytes: int) -> list[tuple]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    n, place, before = cuts(data, offsets, lambda n: np.sort(h[:, :2] % (n[:, None] + 1), 1), chunk_bytes)
    out = []
    for k in range(len(ids)):
        whole = data[offsets[k] : offsets[k + 1]].tobytes()
        if not whole or h[k, 2] % 100 >= rate or _P in whole or _S in whole or _M in whole:
            out.append((int(n[k]), "plain", None, None, whole))
            continue
        a, b = (place[k] - offsets[k]).tolist()
        prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
        spm = h[k, 3] % 100 < spm_rate
        made = b"".join((_S, suffix, _P, prefix, _M, middle) if spm else (_P, prefix, _S, suffix, _M, middle))
        out.append((int(n[k]), "spm" if spm else "psm", int(before[k, 0]), int(before[k, 1] - before[k, 0]), made))
    return out


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Of a hundred texts about `rate` are cut, of these about `spm_rate` in the order suffix, prefix, middle, the others
    in the order prefix, suffix, middle. Draws depend on seed and id alone: rows with one id, null included, draw alike.
    Empty texts, null ones too, and texts that hold a mark stay plain. Each row gives a row, repeated ones too; other
    columns are ignored; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            ends_at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                base = ends_at[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends_at, base + SLICE_BYTES, "right")))
                ids = batch.column(0).slice(at, to - at)
                rows = _rows(ids.to_pylist(), texts.slice(at, to - at), seed, rate, spm_rate, chunk_bytes)
                n, form, prefix, middle, made = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(made, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
                at = to

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its marks stand in it once each."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring_index(output, second, -1)
        return F.substr(F.substring_index(output, second, 1), F.lit(len(first) + 1)), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def digests(docs: DataFrame, **options) -> DataFrame:
    """`transform` with SHA-256 digests of the output and of the text restored from it instead of the output."""
    out = transform(docs, **options)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
