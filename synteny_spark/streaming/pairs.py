"""Adjacency counts kept up to date as genomes arrive: a stream of genes of whole chromosomes, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from synteny_spark.operators.windows import adjacent_pairs, canonical


def batch_counts(genes: DataFrame) -> DataFrame:
    """Oriented pairs (species, pair, n) of a batch that holds its chromosomes whole."""
    pairs = canonical(adjacent_pairs(genes), ["genome"])
    return pairs.groupBy("genome", "a", "sa", "b", "sb").agg(F.count("*").alias("n"))


def follow(genes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's counts to a folder of its own number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return genes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(counts: DataFrame) -> DataFrame:
    """All batches' counts, summed."""
    return counts.groupBy("genome", "a", "sa", "b", "sb").agg(F.sum("n").alias("n"))
