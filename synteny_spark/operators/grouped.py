"""Python kernels over groups of rows, streamed: many small groups share a batch, and a worker holds one group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that is sent back.
ROWS = 10_000


def per_group(df: DataFrame, keys: list[str], kernel: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """kernel's rows for the rows (in the order of df's columns) of each group that is equal in keys, the first of which deals
    groups to tasks together with the others."""
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow, at = to_arrow_schema(out), [df.columns.index(k) for k in keys]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made: list[tuple] = []
        key = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                here = tuple(row[i] for i in at)
                if here != key and held:
                    made += kernel(held)
                    held = []
                    if len(made) >= ROWS:
                        yield batch(made)
                        made = []
                key = here
                held.append(row)
        if held:
            made += kernel(held)
        if made:
            yield batch(made)

    # by a struct: Spark leaves out a shuffle by columns that a join below has dealt by, and then may read that join's own shuffle as it lies
    return df.repartition(F.struct(*keys)).sortWithinPartitions(*keys).mapInArrow(run, out)
