"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synteny_spark.llm import bpe, clustering, conversations, decontam, html_text, licenses, packing, quality, secrets, sharding, simhash, topk, toxicity
from synteny_spark.llm.common import table
from synteny_spark.operators.spread import scratch

#: So small a limit splits shards of the smallest tables.
SMALL_SHARD = 64 << 10

#: Two versions of every document, all scanned, with one ledger, and the second once more.
HISTORY = """WITH v AS (SELECT 1 AS run, coalesce(text, '') AS text FROM documents UNION ALL SELECT 2, coalesce(text, '') || CASE WHEN source IS NULL THEN '' ELSE chr(10) || 'token = rotated-' || source END FROM documents),
w AS (SELECT * FROM v UNION ALL SELECT 3, text FROM v WHERE run = 2), f AS (SELECT text, min(run) AS first FROM w GROUP BY text)
SELECT CAST(w.run AS BIGINT) AS run, count(*) AS n_rows, count(DISTINCT CASE WHEN f.first = w.run THEN w.text END) AS n_scanned FROM w JOIN f USING (text) GROUP BY w.run"""

ORACLES: dict[str, str] = {"op1_sharding": sharding.oracle(), "sharding_small": sharding.oracle(SMALL_SHARD, 40), "secret_history": HISTORY, "op11_conversation_repair": conversations.oracle(), "op12_topk": topk.oracle(), "op13_clustering": clustering.oracle()}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with SMALL_SHARD bytes as the limit."""
    return sharding.assign(table(spark, sf_dir, "documents"), SMALL_SHARD)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place of a licence in a document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each packed sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def secret_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the scan over two versions of all documents, and the second again, with one ledger: rows of results and blobs scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    later = docs.withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit("\ntoken = rotated-"), "source"), F.lit(""))))
    ledger, known, out = f"{scratch(spark, 'secret-history')}/ledger", 0, []
    for run, version in enumerate((docs, later, later), 1):
        rows = secrets.scan(version, ledger).count()
        held = secrets.findings(spark, ledger).count()
        out.append((run, rows, held - known))
        known = held
    return spark.createDataFrame(out, "run long, n_rows long, n_scanned long")  # a row for each run


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation."""
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's best rows."""
    return topk.top(table(spark, sf_dir, "embeddings"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "sharding_small": sharding_small,
    "secret_history": secret_history,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_topk": op12_topk,
    "op13_clustering": op13_clustering,
}
