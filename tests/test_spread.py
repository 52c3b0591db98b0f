"""Joins dealt evenly and components, against brute force."""

import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from synteny_spark.operators import components as comp
from synteny_spark.operators.spread import fresh, shared_dir, spread_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_and_lose_nothing(spark, how):
    rows = [(k, i) for i in range(3000) for k in ([7] if i % 3 == 0 else [i % 500 + 10])]
    left = spark.createDataFrame(rows, "k long, salt long")
    right = spark.createDataFrame([(k, k * k) for k in range(200)], "k long, v long")
    got = spread_join(left, right, ["k"], how)
    assert got.columns == ["k", "salt", "v"]
    want = [(k, i, k * k if k < 200 else None) for k, i in rows if how == "left" or k < 200]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert spread_join(left.limit(0), right, ["k"], how).count() == 0
    assert fresh(["salt", "_SALT"], "salt") == "__salt"


def test_rows_are_dealt_alike_when_a_stage_runs_again(spark):
    """Salts come from what rows hold, not from where they lie."""
    left = spark.createDataFrame([(7, i) for i in range(4000)], "k long, v long")
    plan = spread_join(left, spark.createDataFrame([(7, 1)], "k long, w long"), ["k"])._jdf.queryExecution().analyzed().toString()
    assert "monotonically_increasing_id" not in plan and "xxhash64" in plan


def test_kept_tables_can_be_removed(spark):
    from synteny_spark.operators.spread import discard, exists, written

    df = spark.range(10).withColumn("v", F.col("id") * 2)
    kept = written(df, "some")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert sorted(map(tuple, kept.collect())) == [(i, 2 * i) for i in range(10)] and exists(spark, folder)
    discard(kept)
    assert not exists(spark, folder) and written(df.limit(0), "none").count() == 0


def test_tables_go_with_the_application(tmp_path):
    """An application of its own leaves nothing in the shared folder."""
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from synteny_spark.operators.components import components
import os
assert components(s.createDataFrame([(1, 2), (3, 2)], "x long, y long")).count() == 3
print("kept", sum("kept" in d for d in os.listdir({str(tmp_path)!r})))
s.stop()
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "kept 1" in said.stdout, said.stderr[-800:]
    for _ in range(100):  # the JVM ends after Python
        if not (left := [d for d in tmp_path.iterdir() if "kept" in d.name]):
            break
        time.sleep(0.2)
    assert not left


def test_a_cluster_must_name_its_folder(spark):
    class Far:
        conf, sparkContext = {}, type("C", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError):
        shared_dir(Far)


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("few", [0, 50, 1 << 40])
def test_components(spark, monkeypatch, few):
    """A long path, a hub, mirrored and repeated edges, an edge to itself."""
    monkeypatch.setattr(comp, "FEW", few)
    rng = random.Random(3)
    edges = [(i + 1, i) for i in range(200)] + [(1000, 1001 + i) for i in range(600)] + [(5000, 5000), (7, 7), (6001, 6000), (6000, 6001)]
    edges += [tuple(rng.sample(range(2000, 2400), 2)) for _ in range(250)]
    frame = spark.createDataFrame(edges, "x long, y long")
    assert {r.node: r.component for r in comp.components(frame).collect()} == brute(edges)
    two = comp.components(frame.withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b")))), "k").collect()
    assert len(two) == 2 * len(brute(edges)) and comp.components(frame.limit(0)).count() == 0


def test_closure_of_deep_trees(spark):
    from synteny_spark.operators.trees import closure_of

    rng = random.Random(9)
    parent = {i: i - 1 if i < 70 else rng.randrange(i) for i in range(1, 200)}
    edges = spark.createDataFrame([(str(i), None if i == 0 else str(parent[i])) for i in range(200)], "node string, parent string")
    want = set()
    for i in range(200):
        at, depth = i, 0
        while True:
            want.add((str(at), str(i), depth))
            if at == 0:
                break
            at, depth = parent[at], depth + 1
    got = [tuple(r) for r in closure_of(edges).collect()]
    assert len(got) == len(want) and set(got) == want


def test_evidence_spelled_out_has_the_same_weights(spark):
    from synteny_spark.operators import evidence
    from synteny_spark.plans.queries import _evidence_tables

    tree, genes, families, lineages = _evidence_tables(spark, "/root/testdata/sf0.001")
    obs = evidence.observations(genes, families, lineages)
    spelled = evidence.weights(evidence.propagated(obs, tree.closure(spark)), tree.groups(spark))
    counted = evidence.propagated_weights(obs, tree.closure(spark), tree.groups(spark))
    told = lambda d: sorted(map(tuple, d.select("anc", *evidence.PAIR, "weight").collect()))
    assert told(spelled) == told(counted) and len(told(counted)) > 100


def test_groups_stay_whole_over_a_join_that_turns_into_a_broadcast(spark):
    """Adaptive execution reads such a join's shuffle where it lies, so the kernel's own deal must not be left out for it."""
    from synteny_spark.operators.grouped import per_group

    changed = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(40_000, numPartitions=8).select((F.col("id") % 50).alias("k"), "id")
        right = spark.range(40_000, numPartitions=8).select((F.col("id") % 50).alias("k")).distinct()
        got = per_group(left.join(right, "k"), ["k"], lambda rows: [(rows[0][0], len(rows))], "k long, n long").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(k, 800) for k in range(50)]
