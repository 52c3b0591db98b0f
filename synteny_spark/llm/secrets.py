"""Secret scans by an incremental blob ledger.

Every version of every document is a blob, named by the SHA-256 of its text. The ledger, a Parquet folder by rule version, holds
what each rule version found in each blob. A scan takes only pairs of blob and rule version that the ledger doesn't hold, adds
them to it, and joins the findings back to all documents (paths) that have such a blob, at whatever time. What is found in a blob
follows from the blob and the rules alone, and the ledger is read with each pair once: scans that run at the same time may both
add a pair, which changes no result.

Copies of a blob are dropped in the task that reads them, before blobs move; blobs move compressed. Paths of a blob that many
documents share are dealt to several tasks. Null texts are empty blobs. Spans are in code points, the end exclusive. Repeated rows
give repeated results; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synteny_spark.llm.common import exists, texts, written
from synteny_spark.operators.spread import fresh, spread_join


def either_case(pattern: str) -> str:
    """ASCII letters in either case, and no other letters that fold to them."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


#: kind, pattern, group to measure, its least length; in the order of equal starts. The first three are the base ones.
RULES = (
    ("assign", re.compile(either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("pem", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
)
BASE = ("assign", "access", "hex")
#: Changes with RULES, so that blobs are scanned again.
RULE_VERSION = hashlib.sha256(repr([(k, p.pattern, g, n) for k, p, g, n in RULES]).encode()).hexdigest()[:16]
#: What a text must hold for a rule to find anything, where that is quicker to see.
NEEDS = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ"}


def spans(text: str) -> list[tuple[int, int, str]]:
    """start, end and kind, by start and then by the order of RULES."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        if kind not in NEEDS or NEEDS[kind] in text:
            found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base string, spans string"


def finding(blob: str, text: str, version: str = RULE_VERSION) -> tuple:
    all_ = spans(text)
    base = [x for x in all_ if x[2] in BASE]
    as_text = lambda xs: ",".join(f"{k}:{a}:{b}" for a, b, k in xs)
    return (blob, version, *(sum(k == kind for _, _, k in base) for kind in BASE), as_text(base), as_text(all_))


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)


def blobs(docs: DataFrame) -> DataFrame:
    """blob (SHA-256 in hex) and z (the compressed text), each at most once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                raw = t.encode("utf-8")
                digest = hashlib.sha256(raw)
                if (key := digest.digest()) not in seen:
                    seen.add(key)
                    rows.append((digest.hexdigest(), zlib.compress(raw, 1)))
            yield _columns(rows, ["blob", "z"], [pa.string(), pa.binary()])

    return docs.select("text").mapInArrow(run, "blob string, z binary")


def scanned(unseen: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """The findings of each distinct blob."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split(" ")[0] for x in FINDINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            rows = []
            for blob, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blob not in seen:
                    seen.add(blob)
                    rows.append(finding(blob, zlib.decompress(z.as_py()).decode("utf-8"), version))
            yield _columns(rows, names, kinds)

    return unseen.repartition("blob").mapInArrow(run, FINDINGS)


def findings(spark: SparkSession, ledger: str, version: str = RULE_VERSION) -> DataFrame:
    """The ledger's rows of a rule version, each blob once; none if there is no ledger yet. Another table's folder is an error."""
    if not exists(spark, ledger):
        return spark.createDataFrame([], FINDINGS)
    held = spark.read.parquet(ledger)
    return held.select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in FINDINGS.split(", ")]).where(F.col("rule_version") == version).dropDuplicates(["blob"])


def update_ledger(docs: DataFrame, ledger: str | None = None, version: str = RULE_VERSION) -> DataFrame:
    """Scans what the ledger (a Parquet folder; it may not exist yet) doesn't hold for this rule version, adds it, and returns
    the ledger's rows of this version. Without a ledger, one is begun in the shared folder."""
    here = blobs(docs)
    if not ledger:
        return written(scanned(here, version), "ledger")
    unseen = here.join(findings(docs.sparkSession, ledger, version).select("blob"), "blob", "left_anti")
    scanned(unseen, version).write.mode("append").partitionBy("rule_version").parquet(ledger)
    return findings(docs.sparkSession, ledger, version)


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob, the counts, base and spans ("kind:start:end", comma-joined) of every row."""
    rows = texts(docs, id_col, text_col)
    paths = rows.select("doc_id", F.sha2("text", 256).alias("blob"))
    return spread_join(paths, update_ledger(rows, ledger, version).drop("rule_version"), ["blob"]).select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base", "spans")


MASK = "<secret>"


def mask(text: str, found: str) -> str:
    """text with each stretch of spans (they may overlap) replaced by MASK."""
    out, at = [], 0
    for item in found.split(","):
        _, a, b = item.split(":")
        a, b = max(int(a), at), int(b)
        if b > a:
            out += [text[at:a], MASK] if a > at or not out else [text[at:a]]
            at = b
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """docs, all columns, with secrets masked in the text and n_chars, if there is one, counted anew for texts that change. Null texts
    stay null; columns may have any names."""

    @F.arrow_udf("string")
    def cover(text: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([mask(t, f) for t, f in zip(text.to_pylist(), found.to_pylist())], pa.string())

    text, blob, spans_ = F.col(f"`{text_col}`"), fresh(docs.columns, "blob"), fresh(docs.columns, "spans")
    known = update_ledger(docs.select(F.coalesce(text.cast("string"), F.lit("")).alias("text")), ledger)
    found = known.where("spans <> ''").select(F.col("blob").alias(blob), F.col("spans").alias(spans_))
    met = spread_join(docs.withColumn(blob, F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), found, [blob], "left")
    hit, clean = met.where(F.col(spans_).isNotNull()).withColumn(text_col, cover(text.cast("string"), F.col(spans_))), met.where(F.col(spans_).isNull())
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return hit.select(names).unionByName(clean.select(names))
