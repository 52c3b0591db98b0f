"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint is the majority of the bits of its word shingles' hashes. Distinct fingerprints are dealt to buckets such
that any two within the radius share one: of so many bit blocks, at most RADIUS differ, so all others are equal, and each choice
of that many blocks is a key. How many blocks there are follows from the number of fingerprints: more of them make more keys for
each, but longer ones and so smaller buckets; no choice loses a pair. In a bucket, a table holds every fingerprint's Hamming
distances to PIVOTS reference fingerprints. Distances of two near fingerprints to one pivot differ by their own distance at most,
so a pair is discarded if its greatest coordinate difference is over the radius; only survivors are compared bit by bit.

A bucket gives a spanning forest of its links, not its pairs. Equal texts and equal fingerprints are one fingerprint from the
start. A bucket of over TILE members is tiled: its members are dealt to groups, and every two groups meet in a task of their own,
so that no task holds more than two groups and no link is lost. Components and fingerprints that many rows share are dealt to
several tasks where rows are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synteny_spark.llm.common import per_text, texts
from synteny_spark.operators.components import components
from synteny_spark.operators.spread import checkpointed, fresh, spread_join

RADIUS, PIVOTS, TILE, SHINGLE = 4, 16, 4000, 4
#: What a row costs in a bucket besides its comparisons, in comparisons.
ROW_COST = 60
#: Members up to which all pairs of a bucket are looked at together.
SMALL = 96

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased (A-Z) word shingles, repeats included; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


BITS = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], np.int64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bit k is set if it is in over half of the hashes."""
    h = shingle_hashes(text, size)
    by_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for j in range(8):
        counts = np.bincount(by_byte[:, j], minlength=256) @ BITS
        for k in range(8):
            out |= int(2 * counts[k] > len(h)) << (8 * j + k)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """rows without their last column, text, and with fp, its fingerprint as a signed long."""
    return per_text(rows, lambda: lambda batch: [(signed(fingerprint(t, size)),) for t in batch], "fp long", tuple(rows.columns[:-1]))


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The number of blocks that gives n fingerprints the least work: rows of all keys, and pairs in their buckets."""
    keys = lambda b: len(list(combinations(range(b), radius)))
    return min(range(radius + 1, radius + 7), key=lambda b: keys(b) * (ROW_COST + n / 2 ** (64 * (b - radius) / b)))


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks that two fingerprints within the radius may share whole."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, blocks - radius)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed random ones."""
    return np.random.default_rng(64).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64) % np.uint64(2)


def near(fps: np.ndarray, radius: int, refs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each fingerprint's number with those of later ones (in the order of their distances to the first pivot) that no pivot
    discards."""
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    if len(fps) <= SMALL:
        i, j = np.triu_indices(len(fps), 1)
        left = np.abs(table[i] - table[j]).max(1) <= radius
        i, j = i[left], j[left]
        for k in np.unique(i).tolist():
            yield k, j[i == k]
        return
    order = np.argsort(table[:, 0], kind="stable")
    table = table[order]
    upto = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    for i in range(len(fps) - 1):
        rest = np.arange(i + 1, upto[i])
        for c in range(1, table.shape[1]):
            if not len(rest):
                break
            rest = rest[np.abs(table[rest, c] - table[i, c]) <= radius]
        if len(rest):
            yield int(order[i]), order[rest]


def forest(fps: np.ndarray, radius: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of distinct fingerprints within the radius that join all that can be joined."""
    tree, links = np.arange(len(fps)), []
    for i, rest in near(fps, radius, refs):
        rest = rest[tree[rest] != tree[i]]  # one tree already: no need of a link
        for j in rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius].tolist():
            if tree[j] != tree[i]:
                tree[tree == tree[j]] = tree[i]
                links.append((i, j))
    return links


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, n_pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """Edges (x, y) between distinct fingerprints (column fp, checkpointed or cheap to compute) that give the components of all pairs
    within the radius."""
    masks = block_masks(radius, blocks or blocks_for(distinct.count(), radius))
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("k", "v"))
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1").select("k", "v", F.ceil(F.col("n") / tile).cast("int").alias("groups"))
    met = keyed.join(sizes, ["k", "v"])
    g = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda j: F.struct(F.least(j, F.col("g")).alias("g1"), F.greatest(j, F.col("g")).alias("g2"))))
    tiles = met.withColumn("g", g).select("k", "v", "fp", other.alias("t")).select(F.xxhash64("k", "v", "t.g1", "t.g2").alias("bucket"), "k", "v", "t.g1", "t.g2", "fp")
    names = ["k", "v", "g1", "g2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, held, key = pivots(n_pivots), [], None

        def flush() -> pa.RecordBatch:
            fps = np.array(held, np.int64).view(np.uint64)
            pairs = forest(fps, radius, refs)
            return pa.RecordBatch.from_arrays([pa.array([held[i] for i, _ in pairs], pa.int64()), pa.array([held[j] for _, j in pairs], pa.int64())], names=["x", "y"])

        for batch in batches:
            for *at, fp in zip(*(batch.column(c).to_pylist() for c in (*names, "fp"))):
                if at != key:
                    if len(held) > 1:
                        yield flush()
                    held, key = [], at
                held.append(fp)
        if len(held) > 1:
            yield flush()

    return tiles.repartition("bucket").sortWithinPartitions("bucket", *names).select(*names, "fp").mapInArrow(run, "x long, y long")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp and more, checkpointed) with root, the least fingerprint of its component."""
    found = components(links(distinct.select("fp"), radius))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable by links, its own included) of every row.

    Null and empty texts have fingerprint zero and are linked by it. A null id is no component's least id: such a row gets the
    least id of the others, null if there is none. Repeated rows give repeated results, whatever other columns hold. An empty table
    gives an empty one.
    """
    rows = checkpointed(fingerprints(texts(docs, id_col, text_col)))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    rooted = _rooted(distinct, radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(rooted.select("fp", "root"), least, ["root"]).select("fp", "component_id")
    out = spread_join(rows, named, ["fp"], counts=distinct)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of docs, all columns, for each component: that of the least id (null last), then of the least hash of its whole
    contents. Ids needn't be unique: rows are told apart by all that they hold, and rows equal in everything count as one. An empty
    table gives an empty one; columns may have any names.
    """
    key = fresh(docs.columns, "row_key")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    whole = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), "-").otherwise(F.sha2(text, 256)), rest)
    keyed = docs.withColumn(key, F.unhex(F.sha2(whole, 256)))
    rows = keyed.select(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col(key).alias("key")).alias("who"), F.coalesce(text, F.lit("")).alias("text"))
    first = checkpointed(fingerprints(rows).groupBy("fp").agg(F.min("who").alias("who")))
    chosen = _rooted(first, radius).groupBy("root").agg(F.min("who").alias("who")).select(F.col("who.key").alias(key))
    return keyed.dropDuplicates([key]).join(chosen, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
