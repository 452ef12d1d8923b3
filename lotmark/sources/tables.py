"""The procurement model over a star schema of orders.

A project is an order, its lots (packages) are the order's line states, bidders are suppliers and buyers are
customers. A bid is won if one of its lines was returned ('R'), lost for 'A', else unknown. Money is decimal;
an award without taxed lines has no disclosed amount.

bids() is the fact that most operators read, with one row per (package, organization). It joins lines to
orders first: the aggregation then runs on the join's partitioning, by project, without a second shuffle, and
so do later groupings that hold project_id.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"
#: Bytes of lineitem for a task: some 220,000 lines. Spark alone would deal 64 MB of shuffled rows to each, over ten times as many.
PIECE = 4 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pieces(spark: SparkSession, path: str) -> int:
    """How many tasks a table's rows are dealt to: one for each PIECE of its files, and no fewer than there are cores."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(spark.sparkContext.defaultParallelism, math.ceil(files.getContentSummary(place).getLength() / PIECE))


def dealt(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The rows by key to n tasks; without n, as Spark deals them."""
    return df if n is None else df.repartition(n, key)


def package_id(order: str = "l_orderkey", status: str = "l_linestatus"):
    return (2 * F.col(order) + F.when(F.col(status) == "O", 1).otherwise(0)).alias("package_id")


def bids(lineitem: DataFrame, orders: DataFrame, n: int | None = None) -> DataFrame:
    """project_id, buyer_id, created_at, package_id, package_code, organization_id, outcome, award_amount."""
    lines = lineitem.select("l_orderkey", "l_linestatus", "l_suppkey", "l_returnflag", F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0), F.col("l_extendedprice").cast(MONEY)).alias("won"))
    heads = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("created_at"))
    lines, heads = dealt(lines, "l_orderkey", n), dealt(heads, "o_orderkey", n)
    joined = lines.join(heads, lines["l_orderkey"] == heads["o_orderkey"])
    flag = F.col("l_returnflag")
    outcome = F.when(F.bool_or(flag == "R"), "winner").when(F.bool_or(flag == "A"), "nonwinner").otherwise("unknown")
    per = joined.groupBy("l_orderkey", "o_custkey", "created_at", "l_linestatus", "l_suppkey").agg(outcome.alias("outcome"), F.sum("won").cast(TOTAL).alias("award_amount"))
    return per.select(
        F.col("l_orderkey").alias("project_id"),
        (2 * F.col("o_custkey")).alias("buyer_id"),
        "created_at",
        package_id(),
        F.col("l_linestatus").alias("package_code"),
        (2 * F.col("l_suppkey") + 1).alias("organization_id"),
        "outcome",
        "award_amount",
    )


def items(lineitem: DataFrame, orders: DataFrame, part: DataFrame, n: int | None = None, packages: DataFrame | None = None) -> DataFrame:
    """One row per line: project_id, buyer_id, package_id, part_id, supplier_id, line_no, brand, product_name, category,
    model, quantity, unit_price, total_price (null where the line has no tax); with packages (project_id, package_id, package_code), which
    lie as the lines do, package_code too."""
    heads = orders.select(F.col("o_orderkey").alias("project_id"), (2 * F.col("o_custkey")).alias("buyer_id"))
    lines = lineitem.select(
        F.col("l_orderkey").alias("project_id"),
        package_id(),
        F.col("l_partkey").alias("part_id"),
        (2 * F.col("l_suppkey") + 1).alias("supplier_id"),
        F.col("l_linenumber").cast("long").alias("line_no"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast(MONEY)).alias("total_price"),
    )
    parts = part.select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("string").alias("model"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"),
    )
    met = dealt(lines, "project_id", n).join(dealt(heads, "project_id", n), "project_id")
    if packages is not None:
        of = packages.select(F.col("project_id").alias("_project"), F.col("package_id").alias("_package"), "package_code")
        # as an equality, the package would be a key by which both sides are dealt anew
        met = met.join(of, (F.col("project_id") == F.col("_project")) & (F.col("package_id") <= F.col("_package")) & (F.col("package_id") >= F.col("_package"))).drop("_project", "_package")
    return met.join(parts, "part_id")


def organizations(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """id, name: buyers have even ids, suppliers odd ones."""
    buyers = customer.select((2 * F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))
    return buyers.unionByName(supplier.select((2 * F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name")))


class Model:
    """The model's frames over one folder of tables, made as they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    @cached_property
    def pieces(self) -> int:
        return pieces(self.spark, f"{self.folder}/lineitem.parquet")

    @cached_property
    def bids(self) -> DataFrame:
        return bids(self.table("lineitem"), self.table("orders"), self.pieces)

    @cached_property
    def items(self) -> DataFrame:
        return items(self.table("lineitem"), self.table("orders"), self.table("part"), self.pieces)

    @cached_property
    def coded_items(self) -> DataFrame:
        """items with package_code."""
        return items(self.table("lineitem"), self.table("orders"), self.table("part"), self.pieces, self.packages)

    @cached_property
    def organizations(self) -> DataFrame:
        return organizations(self.table("customer"), self.table("supplier"))

    @cached_property
    def projects(self) -> DataFrame:
        o = self.table("orders")
        return o.select(F.col("o_orderkey").alias("project_id"), (2 * F.col("o_custkey")).alias("buyer_id"), F.to_date("o_orderdate").alias("created_at"), F.col("o_totalprice").cast(MONEY).alias("budget"))

    @cached_property
    def packages(self) -> DataFrame:
        packages = self.table("lineitem").select(F.col("l_orderkey").alias("project_id"), package_id(), F.col("l_linestatus").alias("package_code"))
        return dealt(packages, "project_id", self.pieces).distinct()


#: The same model for DuckDB, as the beginning of a WITH clause.
MODEL_SQL = """
WITH bids AS (
  SELECT l_orderkey AS project_id, 2 * o_custkey AS buyer_id, CAST(o_orderdate AS DATE) AS created_at, 2 * l_orderkey + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS package_id,
    l_linestatus AS package_code, 2 * l_suppkey + 1 AS organization_id,
    CASE WHEN bool_or(l_returnflag = 'R') THEN 'winner' WHEN bool_or(l_returnflag = 'A') THEN 'nonwinner' ELSE 'unknown' END AS outcome,
    sum(CASE WHEN l_returnflag = 'R' AND l_tax > 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS award_amount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  GROUP BY l_orderkey, o_custkey, o_orderdate, l_linestatus, l_suppkey
), awards AS (
  SELECT * FROM bids WHERE outcome = 'winner'
), items AS (
  SELECT l_orderkey AS project_id, 2 * o_custkey AS buyer_id, 2 * l_orderkey + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS package_id, l_partkey AS part_id, 2 * l_suppkey + 1 AS supplier_id,
    CAST(l_linenumber AS BIGINT) AS line_no, p_brand AS brand, p_name AS product_name, p_type AS category, CAST(p_size AS VARCHAR) AS model, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
    CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price, CASE WHEN l_tax > 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS total_price
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
), organizations AS (
  SELECT 2 * c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 2 * s_suppkey + 1, s_name FROM supplier
), projects AS (
  SELECT o_orderkey AS project_id, 2 * o_custkey AS buyer_id, CAST(o_orderdate AS DATE) AS created_at, CAST(o_totalprice AS DECIMAL(18,2)) AS budget FROM orders
), packages AS (
  SELECT DISTINCT l_orderkey AS project_id, 2 * l_orderkey + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS package_id, l_linestatus AS package_code FROM lineitem
)"""
