"""Shuffles with a bounded buffer and takes that stop reading, over tables and over streams."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.hashing import draw
from lodeweave.streaming.files import file_stream


def buffered_shuffle(df: DataFrame, seed: int, buffer_size: int) -> DataFrame:
    """The rows of each partition in a seeded order that a buffer of `buffer_size` rows can make: no row is shuffled between tasks.

    Each row takes the place of a row drawn from the full buffer, which goes out; at the end the buffer goes out in a
    drawn order. A task holds the buffer and one batch. Works on streams too, where each micro-batch is shuffled by
    itself. A buffer of one row keeps the order. The same partitions give the same order.
    """
    if buffer_size < 1:
        raise ValueError("the buffer must hold a row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rng = random.Random(f"{seed}:{context.partitionId() if context else 0}")
        held: pa.Table | None = None
        for batch in batches:
            pool = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            kept = 0 if held is None else held.num_rows
            slots, out = list(range(min(buffer_size, pool.num_rows))), []
            for k in range(max(kept, len(slots)), pool.num_rows):
                j = rng.randrange(len(slots))
                out.append(slots[j])
                slots[j] = k
            held = pool.take(pa.array(slots, pa.int64())).combine_chunks()
            if out:
                yield from pool.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            order = list(range(held.num_rows))
            rng.shuffle(order)
            yield from held.take(pa.array(order, pa.int64())).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)


def shuffled_files(spark: SparkSession, paths: list[str], seed: int, buffer_size: int) -> DataFrame:
    """Parquet files in a seeded order of their names, one partition for a run of them, each shuffled by a buffer.

    The names are metadata; rows are read where they are shuffled.
    """
    names = spark.createDataFrame([(p,) for p in paths], "p string")
    order = [r["p"] for r in names.orderBy(draw(seed, "file", "p"), "p").collect()]
    return buffered_shuffle(spark.read.parquet(*order), seed, buffer_size)


def take_from_files(spark: SparkSession, paths: list[str], each: Callable[[DataFrame], DataFrame], n: int, growth: int = 4) -> DataFrame:
    """The first n rows of each(rows of files) in the order of files and rows; no more files are opened than that needs.

    Files are counted in growing runs, 1, 4, 16, ... of them, until there are n rows; the result reads that run only. `each`
    filters and maps; it must keep the column __at that orders the rows.
    """
    if n < 1:
        raise ValueError("take one row at least")
    rank = {p: k for k, p in enumerate(paths)}
    count = 1
    while True:
        some = paths[:count]
        place = F.create_map(*[F.lit(x) for p in some for x in (p.rsplit("/", 1)[-1], rank[p])])
        rows = spark.read.parquet(*some).withColumn("__at", F.struct(F.try_element_at(place, F.col("_metadata.file_name")).alias("file"), F.col("_metadata.row_index").alias("row")))
        found = each(rows)
        if count >= len(paths) or found.limit(n).count() >= n:
            return found.orderBy("__at").limit(n).drop("__at")
        count = min(len(paths), count * growth)


def take_from_stream(spark: SparkSession, path: str, schema: str, each: Callable[[DataFrame], DataFrame], n: int, out: str, checkpoint: str, files_per_trigger: int = 1) -> int:
    """Appends the first rows that a stream of files gives to `out` until there are n, then ends the stream; returns how many there are.

    The micro-batch behind the last one needed is refused before it is read or committed, so files behind it are never
    opened and are the first that a later call gets. A micro-batch is written to a folder of its number, so one that is
    delivered again after a failure is written over, not twice. A later call goes on from the checkpoint, behind the last
    micro-batch: what of that was over n is not delivered again.
    """
    def there() -> int:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(out)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return spark.read.option("basePath", out).parquet(f"{out}/batch=*").count() if fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/*.parquet")) else 0

    done = []

    def put(batch: DataFrame, number: int) -> None:
        if done:
            raise RuntimeError("there are rows enough")
        batch.limit(0).write.mode("overwrite").parquet(f"{out}/batch={number}")  # what an earlier try of this batch left goes
        left = n - there()
        if left > 0:
            batch.limit(left).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if there() >= n:
            done.append(number)

    held = there()
    if held >= n:
        return held
    query = each(file_stream(spark, path, schema, files_per_trigger)).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not done:
            raise
    return there()
