"""The records that documents are made of, from the supplied tables: policies (orders), accounts, items, charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import listed
from ..shipping import ship

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locator and policy (number, status, priority, amount, start, data) per order; a priority not specified is null."""
    o = table(spark, sf_dir, "orders")
    data = F.struct(F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 200000).alias("large"))
    policy = F.struct(
        F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
        F.col("o_totalprice").cast(MONEY).alias("amount"), F.col("o_orderdate").alias("start"), data.alias("data"),
    )
    return o.select(F.col("o_orderkey").alias("locator"), "o_custkey", policy.alias("policy"))


def items(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """l_orderkey and items in a total order, and more aggregates of the same lines. theft is there for returned lines
    alone, breakdown always."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast(MONEY)
    item = [
        F.col("l_linenumber").alias("line"), price.alias("price"), F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_linestatus").alias("status"),
        F.when(F.col("l_returnflag") == "R", F.struct(F.col("l_linestatus").alias("cover"), price.alias("limit"))).alias("theft"),
        F.struct(F.col("l_returnflag").alias("cover"), F.col("l_quantity").cast(MONEY).alias("limit")).alias("breakdown"),
    ]
    return listed(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], item, more=more)


def category() -> Column:
    """The category of a line's charge, by its flag: premium, tax or nonFinancial."""
    return F.when(F.col("l_returnflag") == "N", "Premium").when(F.col("l_returnflag") == "A", "tax").otherwise("nonFinancial")


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locator, category and amount per line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("locator"), category().alias("category"), F.col("l_extendedprice").cast(MONEY).alias("amount"))


def records(spark: SparkSession, sf_dir: str, *more: Column, account: bool = True) -> DataFrame:
    """locator, policy, account (null without a customer; left out unless asked for), items (null without lines), and more
    aggregates of the lines, all in one pass over them."""
    p = policies(spark, sf_dir)
    if account:
        c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").cast(MONEY).alias("balance"), F.col("c_mktsegment").alias("segment")).alias("account"))
        p = p.join(c, p.o_custkey == c.c_custkey, "left").drop("c_custkey")
    own = items(spark, sf_dir, *more)
    return p.join(own, p.locator == F.col("l_orderkey"), "left").drop("o_custkey", "l_orderkey")


