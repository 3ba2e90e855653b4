"""Tables in the folder that all executors share: they cut the lineage of a loop and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a shuffle that a task is to take, and bytes of files of about as many narrow rows.
TASK_ROWS, TASK_BYTES = 1_000_000, "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, a temporary one for a session in one
    machine (tests), and for others a folder in the warehouse, which all executors share; the session then keeps it as
    its spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="galvani-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/galvani-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as so many rows need, but not fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


@contextmanager
def dealt_out(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is run inside have as many partitions as so many rows need, and keep them, and files are read in
    small pieces: by their compressed bytes, millions of narrow rows would be put together for one task. Few rows go as
    the session has it."""
    if rows <= TASK_ROWS:
        yield
        return
    new = {"spark.sql.shuffle.partitions": str(tasks_for(spark, rows)), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": TASK_BYTES}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


class Scratch:
    """A folder of tables in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/galvani-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, name: str = "table", instead_of: DataFrame | None = None) -> DataFrame:
        """The frame, written as Parquet and read back. The table that `instead_of` was read from, of which nothing more
        than this frame may be derived, is deleted when the new one is whole, so a loop keeps one state on disk."""
        path = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        if instead_of is not None:
            self._paths[id(made)] = (made, path)
            self.drop(instead_of)
        return made

    def drop(self, state: DataFrame) -> None:
        """Deletes a table of `state`, or one written instead of it, of which nothing is read any more."""
        _, old = self._paths.pop(id(state), (None, None))
        if old:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def state(self, df: DataFrame, name: str = "state") -> DataFrame:
        """A table that a later one may be written instead of."""
        path = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(made)] = (made, path)
        return made
