"""Graphs from the tables of the supply chain: places, trade between nations, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .edge_lists import canonical
from .scratch import TASK_ROWS, tasks_for


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a (the customer's nation), b (the supplier's), quantity sold."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    buyers = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
    sellers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    joined = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("a", "b").agg(F.sum("l_quantity").alias("quantity"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(nation_trade(spark, sf_dir), "a", "b")


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World (99) - regions (100 + key) - nations (key) - suppliers (1000 + key), and of each nation of customers its
    most important nation of suppliers in the same region."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    home = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"))
    inside = nation_trade(spark, sf_dir).filter("a <> b").join(home.toDF("a", "ga"), "a").join(home.toDF("b", "gb"), "b").filter("ga = gb")
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("quantity"), "b"))
    pairs = [
        region.select(F.lit(99).alias("u"), (F.col("r_regionkey") + 100).alias("v")),
        nation.select("n_nationkey", F.col("n_regionkey") + 100),
        supplier.select("s_nationkey", F.col("s_suppkey") + 1000),
        inside.withColumn("first", first).filter("first = 1").select("a", "b"),
    ]
    both = pairs[0].select(*(F.col(c).cast("long") for c in pairs[0].columns))
    for p in pairs[1:]:
        both = both.union(p.select(*(F.col(c).cast("long") for c in p.columns)))
    return canonical(both.toDF("u", "v"), "u", "v")


def sparse_trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the supplier that sold it most, and each supplier (1,000,000 + key) with the customer that
    bought most of it (of equal ones the least key): many components, from all lines and orders."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    joined = lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = joined.groupBy("o_custkey", (F.col("l_suppkey") + 1_000_000).alias("s")).agg(F.sum("l_quantity").alias("quantity"))
    by_customer = sold.groupBy("o_custkey").agg(F.max_by("s", F.struct("quantity", -F.col("s"))).alias("s"))
    by_supplier = sold.groupBy("s").agg(F.max_by("o_custkey", F.struct("quantity", -F.col("o_custkey"))).alias("o_custkey"))
    return canonical(by_customer.unionByName(by_supplier), "o_custkey", "s")


def order_part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("u"), (F.col("l_partkey") + 1_000_000_000).alias("v"))


def order_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts (1,000,000,000 + key): the large graph, dealt out by the lines that the files' footers count."""
    rows = read(spark, sf_dir, "lineitem").count()
    return canonical(order_part_pairs(spark, sf_dir), "u", "v", tasks=tasks_for(spark, rows) if rows > TASK_ROWS else None)
