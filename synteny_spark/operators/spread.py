"""Work that survives lost executors and hot keys: the shared folder, tables kept there, and joins dealt evenly."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Keys of the most rows that a join looks at, so what the driver gets is bounded; any other has less than one row in as many.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one if all runs on this machine, else an error:
    executors of a cluster see no folder of the driver's."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def _at(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, as Spark's JVM knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared one; it goes when the application ends, if nothing removes it before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store, at = _at(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the shared folder and read again, so that lost executors cost no recomputation, and plans that use
    it know its true size (the estimates of a checkpoint multiply from join to join, round after round)."""
    path = scratch(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df, "kept")


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` made, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            store, at = _at(df.sparkSession, folder)
            store.delete(at, True)


def fresh(taken: Iterable[str], name: str) -> str:
    """name, or name with underscores before it, unlike any taken one in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right (inner or left), which has each key once at most; no key is null.

    A key of more rows than a task's even share of left has its rows dealt to as many tasks as shares, and its row of right is
    repeated for each. Rows are dealt by a hash of all that they hold, so that a stage that is run again deals them alike. counts:
    keys and n, the rows of left for each key, if that is known already.
    """
    spark = left.sparkSession
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    top = counts.orderBy(F.desc("n")).limit(HOT_KEYS).collect()
    if not top or top[0]["n"] < 100:
        return left.join(right, keys, how)
    share = max(100, counts.agg(F.sum("n")).first()[0] // int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = [(*[r[k] for k in keys], -(-r["n"] // share)) for r in top if r["n"] > share]
    if not hot:
        return left.join(right, keys, how)
    taken = {*left.columns, *right.columns}
    salts, salt = fresh(taken, "salts"), fresh(taken, "salt")
    schema = left.select(*keys).schema.add(salts, IntegerType())
    few = F.broadcast(spark.createDataFrame(hot, schema))  # HOT_KEYS rows at most
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString()])  # the same if a stage is run again
    dealt = left.join(few, keys, "left").withColumn(salt, F.coalesce(F.pmod(hashed, F.col(salts)), F.lit(0)).cast("int")).drop(salts)
    copied = right.join(few, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(salts)
    return dealt.join(copied, [*keys, salt], how).drop(salt)
