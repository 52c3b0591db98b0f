"""The test tables as genomes: which table plays which part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TREE = "(((M1:10,M2:10)A3:0,M3:10)A1:0,(M4:10,M5:10)A2:0)A0;"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sp, chrom, pos, fam, strand, pkey: an order is a chromosome of one species, a line a gene."""
    lines = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return lines.select(
        (F.col("l_orderkey") % 5 + 1).alias("sp"),
        F.col("l_orderkey").alias("chrom"),
        (F.col("l_partkey") % 200).alias("fam"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"),
        F.row_number().over(order).alias("pos"),
        F.col("l_partkey").alias("pkey"),
    )


GENES = """g AS (SELECT l_orderkey % 5 + 1 AS sp, l_orderkey AS chrom, l_partkey % 200 AS fam, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos, l_partkey AS pkey FROM lineitem)"""

PAIRS = (
    GENES
    + """,
p0 AS (SELECT sp, chrom, fam f1, strand s1, lead(fam) OVER (PARTITION BY chrom ORDER BY pos) f2, lead(strand) OVER (PARTITION BY chrom ORDER BY pos) s2 FROM g),
p AS (SELECT * FROM p0 WHERE f2 IS NOT NULL AND f1 <> f2),
c AS (SELECT sp, chrom, CASE WHEN f1 < f2 THEN f1 ELSE f2 END a, CASE WHEN f1 < f2 THEN s1 ELSE -s2 END sa,
  CASE WHEN f1 < f2 THEN f2 ELSE f1 END b, CASE WHEN f1 < f2 THEN s2 ELSE -s1 END sb FROM p)"""
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, block, n: a customer with orders is a block of as many genes."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("block"), "n")


BLOCKS = "bl AS (SELECT c_nationkey AS nation, c_custkey AS block, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("beg"), "event_type")
