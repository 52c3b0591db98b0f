"""Exact top-k search by inner product, with a KD-tree in each shard.

Rows are dealt to shards by a hash of id and vector. A shard's task splits its vectors at the median of the widest dimension,
or at a wide gap near it, and keeps tight bounding boxes. A batch of queries goes down the tree together: the most that an inner product with a vector of a box can
be is the bound, and a box whose bound is under a query's kth score is left with all below it. Leaves that remain are visited best
bound first for each query, and the kth score rises meanwhile; equal scores go to the smaller id, so a bound equal to the kth score
isn't discarded.

Every query is searched in its own shard first. Its kth score there is no more than the true one, so it goes with the query to the
other shards as a bound to begin with, and what comes back from them is little. Queries meet shards in blocks, never rows in pairs.
Of rows equal in id and vector, k + 1 are enough: they tie, and only k of them and the query itself can matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synteny_spark.llm.vectors import EXACT, SQL, named, whole

TOP, EVERY = 20, 20
#: Rows of a shard: at most MOST on average, LEAST at least where there are tasks to spare. Rows of a leaf.
MOST, LEAST, LEAF = 65536, 1024, 256

#: What goes to a shard's task: candidates (searched: false) and queries, with the bound to begin with and what their own shard gave.
ROW = "shard int, searched boolean, vec_id long, v array<long>, copies long, asked boolean, least long, found array<struct<vec_id:long,score:long>>"
FOUND = "query_id long, key binary, copies long, vec_id long, score long"


def cut(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The order of two values or more and the place to cut it: the widest gap in its middle half if that is over a fourth of their extent, else the middle."""
    order = np.argsort(values, kind="stable")
    n, edge, ordered = len(values), max(1, len(values) // 4), values[order]
    gaps = np.diff(ordered)[edge - 1 : n - edge]
    widest = int(gaps.argmax())
    return order, edge + widest if gaps[widest] > (ordered[-1] - ordered[0]) // 4 else n // 2


class Tree:
    """A shard's vectors, in the order of the leaves of its tree. Equal ids and null ones keep the order of the rows given."""

    def __init__(self, ids: list, vectors: np.ndarray, largest: int):
        """largest: the largest component of a query."""
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        self.ids, vectors = [ids[i] for i in order], vectors[order]
        n, size = vectors.shape
        limit = size * largest * int(np.abs(vectors).max(initial=0))
        if limit >> 63:
            raise ValueError("a score may be too large for a long")
        # doubles hold all products and sums exactly; if they might not, or a key of score and place is too long, Python's numbers do
        self.exact = limit < EXACT and (limit + 1) * n < 1 << 62
        self.kind = np.float64 if self.exact else object
        self.key = np.int64 if self.exact else object
        self.lowest = -(1 << 62) if self.exact else -(1 << 200)
        place = np.arange(n)
        self.low, self.high, self.below, self.span = [], [], [], []
        todo = [(0, n, None, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            at, here = len(self.span), vectors[place[a:b]]
            low, high = here.min(0), here.max(0)
            if parent is not None:
                self.below[parent][side] = at
            self.low.append(low), self.high.append(high), self.below.append([-1, -1]), self.span.append((a, b))
            widest = int((high - low).argmax()) if size else 0
            if b - a > LEAF and size and high[widest] > low[widest]:
                order, middle = cut(here[:, widest])
                place[a:b] = place[a:b][order]
                todo += [(a + middle, b, at, 1), (a, a + middle, at, 0)]
        self.low, self.high = np.array(self.low).astype(self.kind), np.array(self.high).astype(self.kind)
        self.leaves = [i for i, (left, _) in enumerate(self.below) if left < 0]
        self.place, self.plain, self.vectors = place, vectors, vectors[place].astype(self.kind)

    def bounds(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The bound of each query (rows) for each leaf, `lowest` where a box above or the leaf's own is under the query's least."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        out = np.full((len(queries), len(self.leaves)), self.lowest, self.key)
        number = {leaf: k for k, leaf in enumerate(self.leaves)}
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            bound = (up[rows] @ self.high[node] + down[rows] @ self.low[node]).astype(self.key)
            stays = bound >= least[rows]
            rows, bound = rows[stays], bound[stays]
            if not len(rows):
                continue
            if node in number:
                out[rows, number[node]] = bound
            else:
                todo += [(child, rows) for child in self.below[node]]
        return out

    def own(self, vec_id, vector: np.ndarray) -> int:
        """The place, among those of ids in order, of a row that is the query itself; -1 if it isn't here."""
        import bisect

        at = bisect.bisect_left(self.ids, vec_id, hi=next((i for i in range(len(self.ids), 0, -1) if self.ids[i - 1] is not None), 0)) if vec_id is not None else len(self.ids)
        while at < len(self.ids) and self.ids[at] == vec_id:
            if (self.plain[at] == vector).all():
                return at
            at += 1
        return -1

    def search(self, queries: np.ndarray, least: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple]]:
        """For each query its best (id, score), k at most, none of a score under least, without the row at place own."""
        n, plain = len(self.ids), queries
        queries = plain.astype(self.kind)
        least = np.maximum(least.astype(self.key), self.lowest // max(n, 1) + 1)
        # one number tells score and place, and so the order: score * n - place
        best = np.full((len(queries), k), self.lowest, self.key)
        bounds = self.bounds(queries, least)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(len(queries))
        for step in range(len(self.leaves)):
            leaf = order[active, step]
            bound = bounds[active, leaf]
            stays = (bound >= least[active]) & (bound > self.lowest)
            active, leaf = active[stays], leaf[stays]
            if not len(active):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            for rows in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                self._visit(int(order[rows[0], step]), rows, queries, least, own, best, k)
        out = []
        for keys in np.sort(best, axis=1)[:, ::-1].tolist():
            pairs = [(-(-x // n), x) for x in keys if x > self.lowest]
            out.append([(self.ids[s * n - x], s) for s, x in pairs])
        return out

    def _visit(self, leaf: int, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, own: np.ndarray, best: np.ndarray, k: int) -> None:
        a, b = self.span[self.leaves[leaf]]
        n, place = len(self.ids), self.place[a:b]
        keys = (queries[rows] @ self.vectors[a:b].T).astype(self.key) * n - place[None, :]
        keys[(place[None, :] == own[rows, None]) | (keys <= (least[rows, None] - 1) * n)] = self.lowest
        better = keys.max(1) > best[rows].min(1)
        rows, keys = rows[better], keys[better]
        if not len(rows):
            return
        both = np.sort(np.concatenate([best[rows], keys], axis=1), axis=1)[:, -k:]
        best[rows] = both
        kth = both[:, 0]
        full = kth > self.lowest
        least[rows[full]] = np.maximum(least[rows[full]], -(-kth[full] // n))


def shards_for(n: int, tasks: int) -> int:
    return max(1, -(-n // MOST), min(tasks, n // LEAST))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, dict[str, list]]]:
    """Stretches of rows of one number of components, either candidates or queries: that number, which of the two, and columns."""
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        kinds = list(zip(map(len, columns["v"]), columns["searched"]))
        start = 0
        for i in range(1, len(kinds) + 1):
            if i == len(kinds) or kinds[i] != kinds[start]:
                yield *kinds[start], {name: c[start:i] for name, c in columns.items()}
                start = i


class Shard:
    """The candidates of one shard and number of components."""

    def __init__(self, k: int):
        self.k, self.ids, self.parts, self.tree, self.largest = k, [], [], None, -1

    def add(self, ids: list, vectors: list, copies: list) -> None:
        each = [min(c, self.k + 1) for c in copies]
        self.ids += [i for i, c in zip(ids, each) for _ in range(c)]
        self.parts.append(np.repeat(np.array(vectors, np.int64).reshape(len(ids), -1), each, axis=0))

    def search(self, ids: list, vectors: list, least: list, home: bool) -> list[list[tuple]]:
        queries = np.array(vectors, np.int64).reshape(len(ids), -1)
        largest = int(np.abs(queries).max(initial=0))
        if self.tree is None or largest > self.largest:
            self.parts, self.largest = [np.concatenate(self.parts)], 2 * largest
            self.tree = Tree(self.ids, self.parts[0], self.largest)
        tree = self.tree
        own = np.array([tree.own(i, q) if home else -1 for i, q in zip(ids, queries)], np.int64)
        return tree.search(queries, np.array([tree.lowest if x is None else x for x in least], object), own, self.k)


def _at_home(shards: DataFrame, k: int) -> DataFrame:
    """Queries (the rows of shards that are asked), each with its best rows of its own shard and, if they are k, the kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None

        def answers() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(held["v"]), 1000):
                part = {name: c[a : a + 1000] for name, c in held.items()}
                found = shard.search(part["vec_id"], part["v"], [None] * len(part["v"]), True)
                part |= {"searched": [True] * len(found), "least": [f[-1][1] if len(f) == k else None for f in found], "found": [[{"vec_id": i, "score": s} for i, s in f] for f in found]}
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in arrow], schema=arrow)

        at = None
        for size, _, columns in _grouped(batches):
            if size != at:
                if shard:
                    yield from answers()
                shard, at, held = Shard(k), size, {name: [] for name in columns}
            shard.add(columns["vec_id"], columns["v"], columns["copies"])
            for i in [i for i, a in enumerate(columns["asked"]) if a]:
                for name, c in columns.items():
                    held[name].append(c[i])
        if shard:
            yield from answers()

    arrow = _schema(shards, ROW)
    return shards.mapInArrow(run, ROW)


def _schema(df: DataFrame, text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], text).schema)


def _elsewhere(rows: DataFrame, k: int) -> DataFrame:
    """FOUND: for queries what other shards have of the least score and more, and for those that bring results of their own, these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for size, searched, columns in _grouped(batches):
            if not searched:
                if size != at:
                    shard, at = Shard(k), size
                shard.add(columns["vec_id"], columns["v"], columns["copies"])
                continue
            abroad = [i for i, f in enumerate(columns["found"]) if f is None]
            found = [[(x["vec_id"], x["score"]) for x in f or ()] for f in columns["found"]]
            if shard and size == at and abroad:
                got = shard.search([columns["vec_id"][i] for i in abroad], [columns["v"][i] for i in abroad], [columns["least"][i] for i in abroad], False)
                for i, f in zip(abroad, got):
                    found[i] = f
            keys = [hashlib.sha256(",".join(map(str, v)).encode()).digest() for v in columns["v"]]
            out = [(q, key, c, i, s) for q, key, c, f in zip(columns["vec_id"], keys, columns["copies"], found) for i, s in f]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    arrow = _schema(rows, FOUND)
    return rows.mapInArrow(run, FOUND)


def top(vectors: DataFrame, asked: Column | None = None, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows, by the inner product of whole numbers.

    asked tells queries by vec_id: those divisible by EVERY unless it is given. A vector that is null or holds a null or a component
    that isn't finite takes no part; vectors of unlike lengths have no score. Equal scores go to the smaller id, a null id comes last and
    asks nothing. A query leaves out its own row alone: other rows of its id or its vector are candidates, and of equal queries each
    has its rows. A score that may be no long is an error. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    asked = F.col("vec_id") % EVERY == 0 if asked is None else asked
    shards = shards or shards_for(vectors.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = whole(named(vectors, id_col, vector_col)).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    none = F.lit(None)
    rows = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("searched"), "vec_id", "v", "copies", F.coalesce(asked, F.lit(False)).alias("asked"), none.cast("long").alias("least"), none.cast("array<struct<vec_id:long,score:long>>").alias("found"))
    by_size = lambda df: df.repartitionById(shards, "shard").sortWithinPartitions(F.size("v"), "searched")
    home = _at_home(by_size(rows), k)
    to = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to")
    queries = home.select("*", to).withColumn("found", F.when(F.col("to") == F.col("shard"), F.col("found"))).withColumn("shard", F.col("to")).drop("to")
    found = _elsewhere(by_size(rows.unionByName(queries)), k)
    order = W.partitionBy("query_id", "key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", each.alias("copy")).drop("copy")


def oracle() -> str:
    """The same in DuckDB, every query against every row."""
    return f"""WITH k AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM ({SQL})),
s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score FROM k AS q JOIN k AS c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= {TOP}"""
