"""Connected components of an edge table: spanning forests of its parts, then large-star and small-star steps, each round kept."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from synteny_spark.operators.spread import checkpointed, discard, spread_join

#: Edges that one task can hold: up to so many it finds the same components without rounds, and more are first brought down to the
#: spanning forests of so many at a time.
FEW = 400_000


def _union_find(edges: DataFrame, keys: list[str], few: int | None) -> DataFrame:
    """(keys,) x and the least y that it is joined with, for every node: of each stretch of `few` edges of a partition, or of the whole
    partition. A root is there only if it is alone, unless few is None."""
    schema = edges.select(*keys, "x", "y").schema
    arrow = to_arrow_schema(schema)
    keyed = bool(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def top(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        def told() -> Iterator[pa.RecordBatch]:
            joined = {r for v, r in root.items() if v != r}
            rows = [(v, top(v)) for v in list(root) if few is None or root[v] != v or v not in joined]
            rows = [(*v, r[-1]) for v, r in rows] if keyed else rows
            root.clear()
            for a in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 100_000]), arrow)], schema=arrow)

        seen = 0
        for batch in batches:
            for *key, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (top((*key, x)), top((*key, y))) if keyed else (top(x), top(y))
                root[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if few is not None and seen >= few:
                yield from told()
                seen = 0
        yield from told()

    return edges.select(*keys, "x", "y").mapInArrow(run, schema)


def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """edges (x, y), y < x. Large star: the neighbours above a node go to the least of its neighbours and itself; small star: those
    below it, and itself, go there."""
    near = edges.union(edges.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"))) if large else edges
    least = near.groupBy(*keys, "x").agg(F.min("y").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("x", "m"))
    to = least.drop("n")
    met = spread_join(near, to, [*keys, "x"], counts=least)
    if large:
        return met.where("y > x").select(*keys, F.col("y").alias("x"), F.col("m").alias("y")).distinct()
    return met.select(*keys, F.col("y").alias("x"), F.col("m").alias("y")).union(to.select(*keys, "x", F.col("m").alias("y"))).where("x <> y").distinct()


def components(edges: DataFrame, key: str | None = None) -> DataFrame:
    """[key,] node, component (the least node) for every node of edges ([key,] x, y).

    Edges may repeat, be mirrored or join a node to itself. Every step keeps the components. Stretches of edges become their
    spanning forests where they lie, which no shuffle precedes; if what is left fits one task, it ends there. Otherwise star steps
    end at stars around the least nodes, in rounds that grow with the logarithm of the longest path. No task holds a hub's
    neighbours alone.
    """
    keys = [key] if key else []
    edges = checkpointed(edges.select(*keys, "x", "y").distinct())
    whole = lambda df: _union_find(df.repartition(1), keys, None).withColumnsRenamed({"x": "node", "y": "component"})
    if edges.count() <= FEW:
        return whole(edges)
    less = checkpointed(_union_find(edges, keys, max(FEW, 1)).distinct())
    discard(edges)
    if less.count() <= FEW:
        return whole(less)
    now, state = less.where("x <> y").select(*keys, F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "x", "y").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        before, now = now if state else None, checkpointed(_star(_star(now, keys, True), keys, False))
        if before is not None:
            discard(before)
        state = seen
    stars = now.select(*keys, F.col("x").alias("node"), F.col("y").alias("component")).union(now.select(*keys, "y", F.col("y").alias("component")).distinct())
    alone = less.where("x = y").select(*keys, F.col("x").alias("node")).join(stars, [*keys, "node"], "left_anti")
    return stars.union(alone.withColumn("component", F.col("node")))
