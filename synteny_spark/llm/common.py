"""What the corpus operators share: Arrow plumbing, and the written tables of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from synteny_spark.operators.spread import discard, exists, written

__all__ = ["discard", "exists", "per_text", "session", "table", "texts", "written"]

#: Rows and bytes of one Arrow batch; long documents must not pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches in this session, which keeps Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, a null text as an empty one: other columns, whatever their names, stay out of the operators."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def per_text(docs: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Applies make()'s function, built once in each task, to the texts of a batch.

    It gets a list of str and returns a tuple of values for each, or None for no row. schema names those values' columns,
    which follow the carried ones.
    """
    kept = docs.select(*carry, "text")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    full = f"{head}, {schema}" if head else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            rows = f(batch.column(batch.num_columns - 1).to_pylist())
            have = [i for i, r in enumerate(rows) if r is not None]
            if not have:
                continue
            columns = [c if len(have) == len(rows) else c.take(pa.array(have)) for c in batch.columns[:-1]]
            columns += [pa.array(v, type=t) for v, t in zip(zip(*(rows[i] for i in have)), arrow[len(carry) :])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.sparkSession.createDataFrame([], full).schema
    arrow = [f.type for f in to_arrow_schema(out)]
    names = out.names
    return kept.mapInArrow(run, out)
