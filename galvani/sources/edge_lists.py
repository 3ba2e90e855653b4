"""Graphs from text files, tables and generators, and results to files. A graph is a table of edges (src, dst), src < dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, a: str, b: str, *keys: str, tasks: int | None = None) -> DataFrame:
    """Distinct edges with src < dst from two key columns of any table; loops and pairs with a null go. `keys` lead each edge.
    With `tasks` they are dealt out to so many."""
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = pairs.filter(u != v).select(*keys, F.least(u, v).alias("src"), F.greatest(u, v).alias("dst"))
    return (edges.repartition(tasks, *edges.columns) if tasks else edges).distinct()


def nodes_of(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Distinct ends of all pairs, those of loops too: a node seen in a loop alone still counts."""
    ends = F.explode(F.array(F.col(a).cast("long"), F.col(b).cast("long"))).alias("node")
    return pairs.select(*keys, ends).filter("node is not null").distinct()


def parse_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """u, v, rejected and value of each line of a column `value`: its first two whole numbers, and whether it has none.
    Comments (# or %) and empty lines go."""
    token = F.split(F.trim("value"), r"\s+")
    kept = lines.filter(~F.coalesce(F.trim("value"), F.lit("")).rlike(r"^(?:[#%]|$)"))
    read = kept.select(*keys, F.get(token, F.lit(0)).try_cast("long").alias("u"), F.get(token, F.lit(1)).try_cast("long").alias("v"), "value")
    return read.withColumn("rejected", F.col("u").isNull() | F.col("v").isNull())


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a text file or folder with an edge a line; further columns of a line are ignored."""
    pairs = parse_lines(spark.read.text(path)).filter("not rejected")
    return canonical(pairs, "u", "v"), nodes_of(pairs, "u", "v")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, n: the lines of a text file or folder that read_edge_list leaves out, as they stand there, and how often."""
    return parse_lines(spark.read.text(path)).filter("rejected").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def read_edge_lists(spark: SparkSession, folder: str, by: str = "file") -> tuple[DataFrame, DataFrame]:
    """As read_edge_list, each file of the folder, or of those below it, a graph of its own, by its path from there as
    `graph_id`; or, by "folder", all files of a folder one graph. Hidden files are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    whole = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    inside = F.substr(whole, F.instr(whole, top + "/") + F.lit(len(top) + 1))
    name = inside if by == "file" else F.regexp_replace(inside, "/?[^/]*$", "")
    pairs = parse_lines(lines.select("value", name.alias("graph_id"), F.element_at(F.split("file", "/"), -1).alias("name")).filter(~F.col("name").startswith(".")), "graph_id").filter("not rejected")
    return canonical(pairs, "u", "v", "graph_id"), nodes_of(pairs, "u", "v", "graph_id")


def path_graph(spark: SparkSession, n: int) -> DataFrame:
    """The path 1 - 2 - ... - n."""
    return spark.range(1, max(n, 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def write_results(df: DataFrame, path: str, how: str = "parquet") -> None:
    """A node table, or a one-row result, as Parquet or CSV with a header."""
    df.write.mode("errorifexists").format(how).option("header", True).save(path)
