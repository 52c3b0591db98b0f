"""Operators along gene order: adjacent pairs, runs, neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synteny_spark.functions.columns import canonical_pair


def sliding(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], width: int = 2) -> DataFrame:
    """Tuples of width successive rows: each column c gives c1, c2, ...; incomplete tuples are left out."""
    w = W.partitionBy(*by).orderBy(*order)
    out = df.select(*by, *[F.lead(c, k).over(w).alias(f"{c}{k + 1}") for k in range(width) for c in columns], F.lead(F.lit(1), width - 1).over(w).alias("__whole"))
    return out.where("__whole = 1").drop("__whole")


def adjacent_pairs(genes: DataFrame, by: Sequence[str] = ("genome", "chrom"), order: Sequence[str] = ("pos",), keep: Sequence[str] = ()) -> DataFrame:
    """by, f1, s1, f2, s2 (and k1, k2 of kept columns k): successive genes of different families; of a run of one family the last
    copy meets the next family."""
    pairs = sliding(genes, by, order, ["fam", "strand", *keep])
    return pairs.where("fam1 <> fam2").select(*by, F.col("fam1").alias("f1"), F.col("strand1").alias("s1"), F.col("fam2").alias("f2"), F.col("strand2").alias("s2"), *[f"{k}{i}" for i in (1, 2) for k in keep])


def canonical(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    return pairs.select(*keep, *canonical_pair(F.col("f1"), F.col("s1"), F.col("f2"), F.col("s2")))


def evidence_weight(counts: DataFrame, pair: Sequence[str] = ("a", "sa", "b", "sb"), n: str = "n") -> DataFrame:
    """Of counts by pair and group of species: the sum over pairs of groups of the products of their counts."""
    return counts.groupBy(*pair).agg(F.expr(f"cast((sum({n}) * sum({n}) - sum({n} * {n})) div 2 as bigint)").alias("weight"))


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], joined: Column, name: str = "run") -> DataFrame:
    """Numbers the runs (from 1) of rows for which joined, a condition over the row before, holds."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__new", F.when(joined, 0).otherwise(1)).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def collinear_runs(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Maximal collinear runs of one-to-one orthologs: points (by, i1, s1, c2, i2, s2), dense in i1. A row continues a run if it is
    on the same chromosome c2, next in the direction that the last strands set, and keeps their relation."""
    w = W.partitionBy(*by).orderBy("i1")
    before = lambda c: F.lag(c).over(w)
    joined = (F.col("c2") == before("c2")) & (F.col("i2") == before("i2") + before("s1") * before("s2")) & (before("s1") * F.col("s1") == before("s2") * F.col("s2"))
    return runs(points, by, ["i1"], joined)


def dedupe_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """Of successive rows with equal values only the first."""
    w = W.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for v in values:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    first = F.row_number().over(w) == 1
    return df.withColumn("__keep", first | ~same).where("__keep").drop("__keep")


def extremities(sequence: DataFrame, by: str, order: Sequence[str], id_: str = "id", strand: str = "s") -> DataFrame:
    """by, side (left or right), id, s, direction: each end of each block, read along it (1) and against it (-1)."""
    e = sequence.groupBy(by).agg(F.min_by(F.struct(id_, strand), F.struct(*order)).alias("first"), F.max_by(F.struct(id_, strand), F.struct(*order)).alias("last"))
    row = lambda side, end, sign, d: F.struct(F.lit(side).alias("side"), F.col(f"{end}.{id_}").alias("id"), (F.col(f"{end}.{strand}") * sign).alias("s"), F.lit(d).alias("direction"))
    return e.select(by, F.inline(F.array(row("left", "first", 1, 1), row("right", "last", 1, 1), row("left", "last", -1, -1), row("right", "first", -1, -1))))


def run_offset(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "offset") -> DataFrame:
    """Place from 0 in the run of equal values."""
    w = W.partitionBy(*by).orderBy(*order)
    numbered = runs(df, by, order, F.lag(value).over(w) == F.col(value), "__run")
    return numbered.withColumn(name, F.row_number().over(W.partitionBy(*by, "__run").orderBy(*order)) - 1).drop("__run")


def is_sorted(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, strict: bool = False) -> DataFrame:
    """by and sorted: whether the value never falls (or always rises) along the order; true for a single row."""
    w = W.partitionBy(*by).orderBy(*order)
    step = F.col(value) > F.lag(value).over(w) if strict else F.col(value) >= F.lag(value).over(w)
    return df.withColumn("__ok", step).groupBy(*by).agg(F.coalesce(F.bool_and("__ok"), F.lit(True)).alias("sorted"))


def near(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, reach: int, name: str = "near") -> DataFrame:
    """The values within reach places of each row, its own included, in order."""
    return df.withColumn(name, F.collect_list(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))


def dense_index(df: DataFrame, by: str, bucket: Column, order: Sequence[str | Column], name: str, kind: str = "int") -> DataFrame:
    """Numbers the rows of each by from 0, by bucket and order: rows are numbered inside their bucket, and only the buckets' counts
    pass through a window of their own. Buckets must be finer than what one task can sort."""
    rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    before = sizes.select(by, "__b", (F.sum("__n").over(W.partitionBy(by).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(W.partitionBy(by, "__b").orderBy(*order)) - 1
    return rows.withColumn("__at", inside).join(before, [by, "__b"]).withColumn(name, (F.col("__before") + F.col("__at")).cast(kind)).drop("__before", "__at", "__b")
