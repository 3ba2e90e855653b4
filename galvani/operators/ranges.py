"""Numbers in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch


def numbered(rows: DataFrame, order: list[str | Column], scratch: Scratch) -> DataFrame:
    """The rows with `id`: 0, 1, ... in that order. They are dealt out by ranges of the order and numbered in each; a
    range then starts from the rows of those before it, of which there is a count for each partition."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    kept = scratch.table(own.withColumn("part", F.shiftright("place", 33).cast("int")), "numbered")
    counts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("start"))
    return kept.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
