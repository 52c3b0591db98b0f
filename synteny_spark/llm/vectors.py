"""Vectors of whole numbers: each component x becomes floor(64 * x), x as a double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCALE = 64
#: Whole numbers that a double holds exactly.
EXACT = 1 << 53

#: In DuckDB: vec_id and v of the vectors that take part.
SQL = f"""SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def flat(vectors: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list array: which vectors take part (not null, no component null or not finite, of `size` components if that is given),
    the whole numbers of all those in one array, and where each begins there (and the end)."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are not finite
    ends = np.cumsum(lengths)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok = vectors.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - lengths])
    if size is not None:
        ok &= lengths == size
    whole = np.floor(SCALE * values[np.repeat(ok, lengths)])
    if len(whole) and np.abs(whole).max() >= EXACT:
        raise ValueError(f"a component of {EXACT / SCALE:g} or more")
    return ok, whole.astype(np.int64), np.concatenate([[0], np.cumsum(lengths[ok])])


def named(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The id and the vector alone: other columns, whatever their names, stay out."""
    from pyspark.sql import functions as F

    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))


def whole(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """vec_id and v (array of long) of the vectors (vec_id, v) that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, values, starts = flat(batch.column(1), size)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), lists], names=["vec_id", "v"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>")
