"""Grouped statistics: NX, nearest-rank quantiles, weighted averages, summaries, best of several, distributions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nx(df: DataFrame, by: Sequence[str], value: str, x: float = 50.0, name: str = "nx") -> DataFrame:
    """The largest value such that it and those above it make up x percent of their group's total; nulls don't count.

    Values are counted first, so a group's window has a row for each distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    down = W.partitionBy(*by).orderBy(F.desc(value))
    mass = F.col(value) * F.col("__n")
    return counts.select(*by, value, F.sum(mass).over(down.rowsBetween(W.unboundedPreceding, 0)).alias("__up"), F.sum(mass).over(W.partitionBy(*by)).alias("__all")).where(F.col("__up") >= F.col("__all") * x / 100.0).groupBy(*by).agg(F.max(value).alias(name))


def quantile(value: str, x: float) -> Column:
    """Aggregate: the element at floor(x * (n - 1) / 100) of the ascending sort."""
    v = F.sort_array(F.collect_list(value))
    return F.get(v, F.floor(F.lit(x) * (F.size(v) - 1) / 100).cast("int"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, xs: dict[str, float]) -> DataFrame:
    """Nearest-rank (lower) quantiles from counts of distinct values, so a group of any size stays small; columns named by xs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    up = W.partitionBy(*by).orderBy(value)
    ranked = counts.select(*by, value, F.sum("__n").over(up.rowsBetween(W.unboundedPreceding, 0)).alias("__to"), F.sum("__n").over(W.partitionBy(*by)).alias("__all"))
    rank = lambda x: F.floor(F.lit(x) * (F.col("__all") - 1) / 100)
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("__to") > rank(x), F.col(value))).alias(k) for k, x in xs.items()])


def weighted_average(value: str) -> Column:
    """Aggregate: the average of lengths weighted by themselves."""
    return F.sum((F.col(value) * F.col(value)).cast("double")) / F.sum(F.col(value).cast("double"))


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: zero where the weights sum to zero."""
    total = F.sum(F.col(weight).cast("double"))
    return F.coalesce(F.sum((F.col(value) * F.col(weight)).cast("double")) / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """min, q25, q50, q75, n75, n50, n25, wa, max, mean, sd (of the population) and n of each group."""
    out = df.groupBy(*by).agg(F.min(value).alias("min"), weighted_average(value).alias("wa"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
    out = out.join(quantiles(df, by, value, {"q25": 25, "q50": 50, "q75": 75}), list(by), "left")
    for x in (75, 50, 25):
        out = out.join(nx(df, by, value, x, f"n{x}"), list(by), "left")
    return out.select(*by, "min", "q25", "q50", "q75", "n75", "n50", "n25", "wa", "max", "mean", "sd", "n")


def summary_text(with_nx: bool = True) -> Column:
    """A row of summary() in one line: min [quartiles] [N75/N50/N25] max [mean/sd-n]."""
    nxs = " [%s/%s/%s]" if with_nx else ""
    args = ["min", "q25", "q50", "q75", *(["n75", "n50", "n25"] if with_nx else []), "max", "mean", "sd", "n"]
    return F.format_string(f"%s [%s/%s/%s]{nxs} %s [%.2f/%.2f-%d]", *args)


def short_summary_text() -> Column:
    return F.when(F.col("n") > 0, F.format_string("min=%s\tN50=%s\tWA=%.2f\tmax=%s", "min", "n50", "wa", "max")).otherwise("no values")


def distribution_text(counts: dict, first: int = 5, last: int = 3) -> str:
    """count:value of a collected histogram by value; of a long one its two ends."""
    items = [f"{counts[v]}:{v}" for v in sorted(counts)]
    return ", ".join(items if len(items) <= first + last else [*items[:first], "...", *items[-last:]])


def histogram(df: DataFrame, *values: str) -> DataFrame:
    return df.groupBy(*values).agg(F.count("*").alias("n"))


def best_of(candidates: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The row of each group with the highest score, of equal ones the first in order; null scores come last."""
    ranked = candidates.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last(score), order)))
    return ranked.where("__k = 1").drop("__k")


def best_reconstruction(blocks: DataFrame) -> DataFrame:
    """Of blocks (anc, candidate, candidate_ord, n): anc, candidate and n50 of the candidate with the highest N50 of all its blocks."""
    n50 = nx(blocks, ["anc", "candidate", "candidate_ord"], "n", 50, "n50")
    return best_of(n50, "anc", "n50", "candidate_ord").select("anc", "candidate", "n50")


def count_matrix(pairs: DataFrame, row: str, column: str, columns: Sequence) -> DataFrame:
    """Ortholog counts of chromosomes against given chromosomes."""
    out = pairs.groupBy(row).pivot(column, list(columns)).agg(F.sum(F.lit(1)))
    return out.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"n{c}") for c in columns])


def dominant(pairs: DataFrame, row: str, column: str, percent: float = 90.0) -> DataFrame:
    """Each row's columns by falling count, up to that which reaches percent of the row's total; ties go by the higher column."""
    counts = pairs.groupBy(row, column).agg(F.count("*").alias("cnt"))
    down = W.partitionBy(row).orderBy(F.desc("cnt"), F.desc(column))
    cum = counts.withColumns({"__cum": F.sum("cnt").over(down.rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum("cnt").over(W.partitionBy(row))})
    return cum.where(F.col("__cum") - F.col("cnt") < F.col("__all") * percent / 100.0).select(row, column, "cnt")


def jaccard(a: str, b: str) -> Column:
    """Of two array columns, as sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)).cast("double")


def composition(df: DataFrame, by: Sequence[str], text: str, alphabet: str, k: int = 1) -> DataFrame:
    """How often each string of k letters of the alphabet occurs in the texts of a group, without case; overlaps count. One scan of
    a text for each of the strings, of which there are few."""
    words = ["".join(w) for w in product(alphabet, repeat=k)]
    low = F.lower(F.col(text))
    each = lambda w: F.char_length(low) - F.char_length(F.replace(low, F.lit(w))) if k == 1 else F.regexp_count(low, F.lit(f"(?={w})"))
    sums = df.groupBy(*by).agg(*[F.sum(each(w).cast("bigint")).alias(f"__{w}") for w in words])
    rows = F.inline(F.array(*[F.struct(F.lit(w).alias("letters"), F.col(f"__{w}").alias("n")) for w in words]))
    return sums.select(*by, rows).where("n > 0")


def gene_density(genes: DataFrame) -> DataFrame:
    """Of genes (genome, chrom, beg, end): each chromosome's genes, extent, gene length and mean distance between genes."""
    g = genes.groupBy("genome", "chrom").agg(F.count("*").alias("n"), (F.max("end") - F.min("beg")).alias("extent"), F.sum(F.col("end") - F.col("beg")).alias("covered"))
    return g.withColumn("mean_gap", (F.col("extent") - F.col("covered")) / F.nullif(F.col("n") - 1, F.lit(0)))


def window_content(sequence: str, first: Column, last: Column, wanted: Sequence[str]) -> tuple[Column, Column]:
    """Of a sequence column's letters first to last (from 0), or its pairs of letters that begin there before last: how many there are
    without an N, and how many of these are wanted. wanted has strings of one length, one or two; pairs overlap."""
    k = len(wanted[0])
    part = F.substring(F.col(sequence), first + 1, last - first + 1)
    at = F.sequence(F.lit(1), F.greatest(F.char_length(part) - (k - 1), F.lit(1)))
    whole = F.transform(at, lambda i: F.substring(part, i, F.lit(k)))
    known = F.filter(whole, lambda x: (F.char_length(x) == k) & ~x.contains("N"))
    return F.size(known).cast("bigint"), F.size(F.filter(known, lambda x: x.isin(*wanted))).cast("bigint")


def family_composition(families: DataFrame, genes: DataFrame) -> DataFrame:
    """anc, fam_idx, species, members: each family's genes in each species that has any; genes has species and name. Genes that no
    species has are left out, repeated names count once."""
    each = families.select("anc", "fam_idx", F.explode("members").alias("name"))
    met = each.join(genes.select("species", "name").distinct(), "name")
    return met.groupBy("anc", "fam_idx", "species").agg(F.sort_array(F.collect_set("name")).alias("members"))
