"""Bulk tree questions against walks up the tree."""

import random

from synteny_spark.operators import tours

PARENT = {}


def forest():
    rng = random.Random(4)
    out = {"r0": None, "s0": None, "lone": None}
    for i in range(1, 40):
        out[f"r{i}"] = f"r{i - 1}" if i < 15 else f"r{rng.randrange(i)}"
    for i in range(1, 12):
        out[f"s{i}"] = f"s{rng.randrange(i)}"
    return out


def up(parent, n):
    while n is not None:
        yield n
        n = parent[n]


def test_tours_totals_and_common_ancestors(spark, monkeypatch):
    monkeypatch.setattr(tours, "CELL", 7)
    parent = forest()
    tour = tours.toured(spark.createDataFrame(list(parent.items()), "node string, parent string"))
    rows = {r.node: r for r in tour.collect()}
    below = {n: [m for m in parent if n in up(parent, m)] for n in parent}
    for n, r in rows.items():
        way = list(up(parent, n))
        assert (r.root, r.depth, r.size, r.parent) == (way[-1], len(way) - 1, len(below[n]), parent[n])
        assert sorted(rows[m].number for m in below[n]) == list(range(r.number, r.number + r.size))
    values = {n: len(n) + i for i, n in enumerate(parent) if i % 5}
    cut = ["r7", "r9", "s3", "lone", "none"]
    got = {r.node: (r.total, r.n) for r in tours.pruned_totals(tour, spark.createDataFrame(list(values.items()), "node string, value long"), spark.createDataFrame([(c,) for c in cut], "node string")).collect()}
    left = [n for n in parent if not set(cut) & set(up(parent, n))]
    assert got == {n: (sum(values.get(m, 0) for m in below[n] if m in left), sum(m in left for m in below[n])) for n in left}
    pairs = [(a, b, i) for i, (a, b) in enumerate((a, b) for a in list(parent)[::2] + ["gone"] for b in list(parent)[::3])]
    found = tours.common_ancestors(tour, spark.createDataFrame(pairs, "a string, b string, i int")).collect()
    assert len(found) == sum(a != "gone" for a, _, _ in pairs)
    for r in found:
        one, two = list(up(parent, r.a)), list(up(parent, r.b))
        top = next((x for x in one if x in two), None)
        assert (r.lca, r.above) == (top, r.a in two) and (r.steps == one.index(top) + two.index(top) if top else r.steps is None)


def test_no_trees(spark):
    none = spark.createDataFrame([], "node string, parent string")
    assert tours.toured(none).count() == 0
