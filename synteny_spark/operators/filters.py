"""Predicates over genomes and blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synteny_spark.functions.columns import contig_type
from synteny_spark.operators.stats import nx


def placed_contigs(genes: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Genes on chromosomes and scaffolds."""
    return genes.where(contig_type(F.col(chrom)).isin("Chromosome", "Scaffold"))


def keep_named(genes: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Genes of which a name is among names."""
    return genes.join(names.select(name).distinct(), name, "left_semi")


def drop_named(genes: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Genes of which no name is among names; a gene with a null name stays."""
    return genes.join(names.select(name).distinct(), name, "left_anti")


def min_chromosome_size(genes: DataFrame, least: int, by: Sequence[str] = ("genome", "chrom")) -> DataFrame:
    """Genes of chromosomes with that many; sizes are counted first, so no chromosome is held whole."""
    sizes = genes.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return genes.join(sizes.drop("__n"), list(by), "left_semi")


def reindex(genes: DataFrame, keep: Column, by: Sequence[str] = ("genome", "chrom"), order: Sequence[str] = ("pos",), original: str = "orig_idx") -> DataFrame:
    """Kept genes with a dense idx from 0, and their index before; an earlier round's original index is carried on."""
    w = W.partitionBy(*by).orderBy(*order)
    before = F.col(original) if original in genes.columns else F.row_number().over(w) - 1
    return genes.withColumn(original, before).where(keep).withColumn("idx", F.row_number().over(w) - 1)


def at_least(edges: DataFrame, weight: int) -> DataFrame:
    return edges.where(F.col("weight") >= weight)


def genes_at(genes: DataFrame, chrom, beg: int, end: int, only_inside: bool = False) -> DataFrame:
    """Genes of a chromosome that overlap an interval, or lie in it."""
    on = genes.where(F.col("chrom") == F.lit(chrom))
    return on.where((F.col("beg") >= beg) & (F.col("end") <= end)) if only_inside else on.where((F.col("end") >= beg) & (F.col("beg") <= end))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Range join: rows of right (key, beg2, end2) that overlap those of left (key, beg, end), where no interval is longer than
    width: both go to bins of that width, so one key's rows meet only near each other."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    l, r = left.withColumn("__bin", bins("beg", "end")), right.withColumn("__bin", bins("beg2", "end2"))
    met = l.join(r, [key, "__bin"]).where((F.col("beg") <= F.col("end2")) & (F.col("beg2") <= F.col("end")))
    return met.where(F.col("__bin") == F.greatest(F.floor(F.col("beg") / width), F.floor(F.col("beg2") / width))).drop("__bin")  # once


def unique_names(genes: DataFrame, genome: str, name: str) -> DataFrame:
    return genes.withColumn(name, F.concat_ws(".", genome, name))


def singleton_edges(edges: DataFrame, singletons: DataFrame) -> DataFrame:
    """Edges (anc, g1, .., g2, ..) of which both ends are singletons (anc, id)."""
    for end in ("g1", "g2"):
        edges = edges.join(singletons.select("anc", F.col("id").alias(end)).distinct(), ["anc", end], "left_semi")
    return edges


def _emptied(blocks: DataFrame, keep: Column) -> DataFrame:
    """Blocks that fail stay as empty rows, so that ids don't move."""
    empty = {c: F.when(keep, F.col(c)).otherwise(F.array().cast(blocks.schema[c].dataType)) for c in ("ids", "strands", "support") if c in blocks.columns}
    return blocks.withColumns(empty | {"n": F.when(keep, F.col("n")).otherwise(F.lit(0).cast(blocks.schema["n"].dataType))})


def filter_blocks_fixed(blocks: DataFrame, least: int) -> DataFrame:
    """Blocks of fewer than least genes are emptied."""
    return _emptied(blocks, F.col("n") >= least)


def filter_blocks_proportional(blocks: DataFrame, percent: float, by: Sequence[str] = ("anc",)) -> DataFrame:
    """Blocks below their ancestor's NX at percent are emptied."""
    cut = nx(blocks, by, "n", percent, "__cut")
    return _emptied(blocks.join(cut, list(by), "left"), F.coalesce(F.col("n") >= F.col("__cut"), F.lit(False))).drop("__cut")


def copy_blocks(blocks: DataFrame, ancestors: Sequence[str]) -> DataFrame:
    return blocks.where(F.col("anc").isin(*ancestors))
