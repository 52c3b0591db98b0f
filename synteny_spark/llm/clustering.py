"""Centroid clustering by scalar lookup tables.

Vectors hold whole numbers. In each round a task tabulates the squared difference of every whole number that occurs in a dimension
from each centroid's component there; a distance is then a sum of table entries, gathered by NumPy. Tables hold at most KNOWN values
of a dimension (beyond that they begin anew with those of a batch, which has fewer), so they don't grow with the data.

A round is one scan: each task gives a count, sums and inertia for each centroid, which Spark adds up; the driver gets as many
numbers as centroids have components. Nothing is kept between rounds but the centroids, and only the id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synteny_spark.llm.vectors import SQL, flat, named, whole

SIZE, CENTROIDS, ROUNDS, SEED = 64, 16, 3, 1
KNOWN = 4096

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Tables:
    """Squared differences by dimension, occurring value and centroid."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        size = self.centroids.shape[1]
        #: The farthest that a component may be from zero for a distance to be a long.
        self.most = 1 << ((62 - (size - 1).bit_length()) // 2 - 1)
        if np.abs(self.centroids).max(initial=0) > self.most:
            raise ValueError(f"a component beyond {self.most} may make a distance too large for a long")
        self.values = [np.empty(0, np.int64)] * size
        self.squares = [np.empty((0, len(centroids)), np.int64)] * size

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances, a row for each vector and a column for each centroid."""
        if np.abs(vectors).max(initial=0) > self.most:
            raise ValueError(f"a component beyond {self.most} may make a distance too large for a long")
        out = np.zeros((len(vectors), len(self.centroids)), np.int64)
        for d in range(vectors.shape[1]):
            at = self._places(d, vectors[:, d])  # may make the table anew
            out += self.squares[d][at]
        return out

    def _places(self, d: int, column: np.ndarray) -> np.ndarray:
        """Rows of dimension d's table, which gets the values that it lacks."""
        known = self.values[d]
        at = np.searchsorted(known, column)
        if len(known) and (known[np.minimum(at, len(known) - 1)] == column).all():
            return at
        known = np.union1d(known, column)
        if len(known) > KNOWN:
            known = np.unique(column)
        self.values[d], self.squares[d] = known, (known[:, None] - self.centroids[None, :, d]) ** 2
        return np.searchsorted(known, column)


def _nearest(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each batch: ids, vectors, the nearest centroid's number (of equal ones the smaller) and the distance."""
    tables, size = Tables(centroids), len(centroids[0])
    for batch in batches:
        ok, values, _ = flat(batch.column(1), size)
        if not ok.any():
            continue
        vectors = values.reshape(-1, size)
        distances = tables.distances(vectors)
        nearest = distances.argmin(1)
        yield batch.column(0).filter(pa.array(ok)), vectors, nearest, distances[np.arange(len(vectors)), nearest]


def first_centroids(vectors: DataFrame, size: int, n: int, seed: int) -> list[list[int]]:
    """The n vectors of the least SHA-256 of `seed:vec_id`; of one id the least vector comes first. A null id is written as nothing."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.v for r in whole(vectors, size).orderBy(name, "v").limit(n).collect()]


def totals(vectors: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]], list[int]]:
    """For each centroid: how many vectors are nearest to it, their componentwise sums, and the sum of their distances."""
    size = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (size + 2) for _ in centroids]
        for _, rows, nearest, distance in _nearest(batches, centroids):
            for c in np.unique(nearest).tolist():
                here = nearest == c
                parts = [int(here.sum()), sum(distance[here].tolist()), *rows[here].sum(0).tolist()]
                sums[c] = [x + y for x, y in zip(sums[c], parts)]
        full = [(c, [str(x) for x in s]) for c, s in enumerate(sums) if s[0]]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in full], pa.int32()), pa.array([s for _, s in full], pa.list_(pa.string()))], names=["cluster", "parts"])

    parts = vectors.mapInArrow(run, "cluster int, parts array<string>").select("cluster", F.posexplode("parts").alias("at", "part"))
    found = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = [[0] * (size + 2) for _ in centroids]
    for r in found:  # centroids times components
        out[r["cluster"]][r["at"]] = int(r["total"])
    return [o[0] for o in out], [o[2:] for o in out], [o[1] for o in out]


def fit(vectors: DataFrame, size: int = SIZE, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after so many rounds: each becomes the floor of the mean of its vectors, one without vectors stays. Fewer
    vectors than n make fewer centroids, none make none."""
    centroids = first_centroids(vectors, size, n, seed)
    for _ in range(rounds if centroids else 0):
        counts, sums, _ = totals(vectors, centroids)
        centroids = [[s // k for s in total] if k else c for c, k, total in zip(centroids, counts, sums)]
    return centroids


def cluster(vectors: DataFrame, size: int = SIZE, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """RESULT for each vector of `size` components, none null or not finite; others are left out.

    vectors are read again in each round: give a table, not a costly plan. Rows with a null id are rows like others, and repeated
    rows count as often as they are there. A component so large that a distance may be no long is an error. An empty table gives an
    empty one.
    """
    rows = named(vectors, id_col, vector_col)
    centroids = fit(rows, size, n, rounds, seed)
    if not centroids:
        return rows.sparkSession.createDataFrame([], RESULT)
    _, _, inertia = totals(rows, centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    names, all_inertia = [f.split()[0] for f in RESULT.split(", ")], sum(inertia)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, nearest, distance in _nearest(batches, centroids):
            here = pa.array(nearest, pa.int32())
            columns = [ids, here, pa.array(distance, pa.int64()), pa.array(inertia, pa.int64()).take(here), pa.array([all_inertia] * len(nearest), pa.int64()), pa.array(digests).take(here)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, RESULT)


def oracle() -> str:
    """The same in DuckDB, round by round."""
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': CAST({apart} AS BIGINT), 'c': c.c}}) AS best FROM k, c{i} AS c GROUP BY r)")
        if i < ROUNDS:
            mean = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            rounds.append(f"m{i} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT best.c AS c, i, {mean} AS x FROM (SELECT best, unnest(v) AS x, unnest(range({SIZE})) AS i FROM k JOIN a{i} USING (r)) GROUP BY 1, 2) GROUP BY c)")
            rounds.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c AS c, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m ON m.c = c.c)")
    return f"""WITH k AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM ({SQL} AND len(embedding) = {SIZE})),
c0 AS MATERIALIZED (SELECT row_number() OVER w - 1 AS c, v FROM k WINDOW w AS (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) QUALIFY row_number() OVER w <= {CENTROIDS}),
{', '.join(rounds)},
f AS (SELECT vec_id, best.c AS c, best.d AS d FROM k JOIN a{ROUNDS} USING (r))
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} AS c ON c.c = f.c"""
