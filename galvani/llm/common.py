"""What the text operators share: reading tables, and which rows a classifier may learn from."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvani.sources.scratch import Scratch as SharedTables

__all__ = ["Scratch", "bound_batches", "frugal", "give_back", "held_out", "id_and_text", "lots", "placed", "read"]


#: Bytes of the batches that a task and its Python worker hold, unless the session says otherwise: texts may be long.
BATCH_BYTES = 4_000_000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


class Scratch(SharedTables):
    """Tables in the shared folder, for a session with batches of bounded size."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        super().__init__(spark)


def give_back(result=None):
    """A worker gives the memory that it has freed back to the machine: workers live on from stage to stage, and would
    otherwise keep the most that any stage has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return result


def frugal(run):
    """The function of batches, with give_back at the end of a task."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def lots(batches, chars: int, rows: int = 1000):
    """The batches in slices of at most so many rows and, but for one long text, about so many bytes."""
    for batch in batches:
        at, size = 0, 0
        for k, text in enumerate(batch.column("text")):
            size += text.as_buffer().size if text.is_valid else 0
            if size >= chars or k + 1 - at >= rows:
                yield batch.slice(at, k + 1 - at)
                at, size = k + 1, 0
        if at < batch.num_rows or not batch.num_rows:
            yield batch.slice(at)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, so that further columns cannot clash."""
    bound_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def held_out(doc_id) -> F.Column:
    """Rows that a classifier must not learn from: crc32 of the id as text, modulo 4, is 2 (a null id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def placed(rows: DataFrame, order: list, value: str, scratch: Scratch) -> DataFrame:
    """The rows with `before`, the sum of the whole numbers of column `value` over all rows before them in that order.

    They are dealt out by ranges of the order and summed in each; a range then starts from the sum of those before it,
    of which there is a row for each partition.
    """
    names = rows.columns

    def run(batches):
        total = 0
        for batch in batches:
            now = batch.column(value).to_numpy(zero_copy_only=False)
            yield batch.append_column("before", pa.array(total + np.cumsum(now) - now, pa.int64()))
            total += int(now.sum())

    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kept = scratch.table(own.mapInArrow(run, own.withColumn("before", F.lit(0).cast("long")).schema), "placed")
    sums = kept.groupBy("part").agg(F.sum(value).alias("in_part"))
    starts = sums.select("part", (F.sum("in_part").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("in_part")).alias("start"))
    return kept.join(F.broadcast(starts), "part").select(*names, (F.col("before") + F.col("start")).alias("before"))
