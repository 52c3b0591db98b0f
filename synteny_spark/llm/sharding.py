"""Sharding by extendible hashing.

A row's hash is 60 bits of the MD5 of its id and text. The directory begins with one bucket; a bucket over the byte limit splits
on the next bit, and only such a bucket, until every shard fits. Sizes are summed for all hash prefixes of one depth at once, and
again, deeper, only below prefixes that are still too large, so nothing but sums of prefixes moves.

Rows with equal ids and texts share all bits; a shard of such rows alone, or of one row over the limit, stays whole at the full
depth. Null ids and texts hash as absent, and a null text has no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synteny_spark.operators.spread import checkpointed

BITS, LIMIT = 60, 64 << 20


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (60 bits) and bytes of every row."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), text).cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(key.alias("doc_id"), h.alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))


def _sums(cells: DataFrame, first: int, depth: int) -> DataFrame:
    """Bytes of every prefix of first to depth bits: from the cells of depth bits up, each level from the one below it."""
    level = cells.select(F.lit(depth).alias("depth"), F.col("cell").alias("prefix"), "bytes")
    out = level
    for d in range(depth - 1, first - 1, -1):
        level = level.groupBy(F.lit(d).alias("depth"), F.shiftright("prefix", 1).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        if (depth - d) % 4 == 0:
            level = checkpointed(level)
        out = out.union(level)
    return out


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, shard (its bits, "" for the only one), depth and shard_bytes of every row."""
    rows = checkpointed(hashed(docs, id_col, text_col))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    first, depth, parts = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + 4), []
    while True:
        keyed = rows.withColumn("cell", F.shiftright("h", BITS - depth))
        cells = checkpointed(keyed.groupBy("cell").agg(F.sum("bytes").alias("bytes")))
        sums = checkpointed(_sums(cells, first, depth))
        fits = sums.where(F.col("bytes") <= limit) if depth < BITS else sums.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        above = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = fits.withColumn("parent", F.shiftright("prefix", 1)).join(above, ["depth", "parent"], "left_semi") if depth else fits.limit(0)
        shards = split.select("depth", "prefix", F.col("bytes").alias("shard_bytes")).union(fits.where(F.col("depth") == first).select("depth", "prefix", "bytes"))
        where = cells.select("cell", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)")).join(shards, ["depth", "prefix"])
        parts.append(keyed.join(where, "cell").select("doc_id", F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')")).alias("shard"), "depth", "shard_bytes"))
        large = sums.where((F.col("depth") == depth) & (F.col("bytes") > limit)).select(F.col("prefix").alias("cell"))
        if depth == BITS or large.isEmpty():
            break
        rows = checkpointed(keyed.join(large, "cell", "left_semi").select("doc_id", "h", "bytes"))
        first, depth = depth + 1, min(BITS, depth + 8)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def oracle(limit: int = LIMIT, depths: int = 24) -> str:
    """The same rows in DuckDB's SQL, where no shard is deeper than depths."""
    return f"""
    WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h,
                      CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents),
    s AS (SELECT CAST(g.k AS INTEGER) AS depth, h >> (60 - g.k) AS prefix, CAST(sum(bytes) AS BIGINT) AS bytes FROM d, range(0, {depths + 1}) g(k) GROUP BY 1, 2),
    f AS (SELECT a.* FROM s a LEFT JOIN s p ON p.depth = a.depth - 1 AND p.prefix = a.prefix >> 1
          WHERE a.bytes <= {limit} AND (a.depth = 0 OR p.bytes > {limit}))
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard, depth, f.bytes AS shard_bytes
    FROM d JOIN f ON d.h >> (60 - f.depth) = f.prefix"""
