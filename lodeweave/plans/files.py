"""Queries that go through files: matrices, chunks, shuffles and takes; what they write lies in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators.lineage import scratch
from lodeweave.sources import arrays, chunks
from lodeweave.streaming import samples

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


@_add("k12_matrix_files", "SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def _(s, d):
    path = scratch(s, "arrays")
    arrays.write_embeddings(_t(s, d, "embeddings"), path, "vec_id", "embedding")
    read = s.read.format("npy").option("path", f"{path}/arrays").option("partition_bytes", 1 << 16).load()
    rows = read.withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return s.read.parquet(f"{path}/metadata").join(rows, ["file", "row"]).select("vec_id", F.size("vector").cast("long").alias("width"), F.round(total, 4).alias("total"), F.round(F.col("vector")[0], 6).alias("first"))


@_add("k02_resumed_chunks", "SELECT (doc_id % 7)::INT AS chunk, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(s, d):
    docs, path = _t(s, d, "documents").select("doc_id", "n_chars"), scratch(s, "chunks")
    config = {"table": "documents", "columns": ["doc_id", "n_chars"], "chunks": 7}
    # the first run gets to some chunks only; the second goes on with the others
    number = F.pmod("doc_id", F.lit(7))
    chunks.write_chunks(docs.where(number < 3), path, config, number, 3)
    folder = chunks.write_chunks(docs, path, config, number, 7, wave=3)
    return chunks.read_chunks(s, folder, "doc_id long, n_chars long").groupBy("chunk").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@_add("o06_early_take", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 2000 ORDER BY doc_id LIMIT 50")
def _(s, d):
    files = sorted(_t(s, d, "documents").inputFiles())
    return samples.take_from_files(s, files, lambda rows: rows.where("n_chars > 2000").select("__at", "doc_id", "n_chars"), 50)


@_add("o08_buffered_shuffle", "SELECT doc_id, lang FROM documents")
def _(s, d):
    return samples.buffered_shuffle(_t(s, d, "documents").select("doc_id", "lang"), 5, 100)
