"""Questions about trees in bulk: Euler tours, common ancestors, totals of pruned sub-trees.

A tour goes down to a node, through its children's tours, and up again. Each of these steps points to the next one, and pointers that
double tell for all steps at once how many go down, and how many up, from there to the end: so a node's number in the order of the tour,
its depth and the size of its sub-tree, in rounds that grow with the logarithm of the tree, however deep it is. A sub-tree is
then a range of numbers, its total a difference of two running sums. The common ancestor of two nodes is above the shallowest node
between them, which a table of ranges of two, four, eight ... nodes tells with two look-ups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synteny_spark.operators.spread import checkpointed, discard

#: Numbers of a tour that are summed together before the sums of such cells are.
CELL = 4096


def pointed(steps: DataFrame, keys: Sequence[str], sums: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """steps (keys, x, to, done, sums, keep) with to the last x that pointers lead to and sums of all on the way, the last one's
    included. A last step points to itself and is done."""
    now = checkpointed(steps.select(*keys, "x", "to", *sums, *keep, "done"))
    while now.where("not done").take(1):
        ahead = now.select(*keys, F.col("x").alias("to"), F.col("to").alias("then"), *[F.col(s).alias(f"more_{s}") for s in sums], F.col("done").alias("over"))
        moved = now.where("not done").join(ahead, [*keys, "to"]).select(*keys, "x", F.col("then").alias("to"), *[(F.col(s) + F.col(f"more_{s}")).alias(s) for s in sums], *keep, F.col("over").alias("done"))
        before, now = now, checkpointed(moved.unionByName(now.where("done")))
        discard(before)
    return now.drop("done")


def toured(edges: DataFrame) -> DataFrame:
    """node, parent, root, number (from 0 in the root's tree, a node before its children, these by name), size (of its sub-tree) and
    depth of every node of edges (node, parent; null: a root), names being text."""
    siblings = W.partitionBy("parent").orderBy("node")
    rows = checkpointed(edges.select("node", "parent", F.when(F.col("parent").isNotNull(), F.lead("node").over(siblings)).alias("next")))
    first = rows.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    step = lambda way, node: F.concat(F.lit(way), node)
    node, parent = F.col("node"), F.col("parent")
    after_down = F.coalesce(step("+", F.col("child")), step("-", node))
    after_up = F.coalesce(step("+", F.col("next")), step("-", parent), step("-", node))
    side = lambda way, to, down, done: F.struct(step(way, node).alias("x"), to.alias("to"), F.lit(down).cast("long").alias("downs"), F.lit(1 - down).cast("long").alias("ups"), done.alias("done"))
    steps = rows.join(first, "node", "left").select(F.inline(F.array(side("+", after_down, 1, F.lit(False)), side("-", after_up, 0, parent.isNull()))))
    told = pointed(steps, [], ["downs", "ups"])
    way, name = F.substring("x", 1, 1), F.expr("substring(x, 2)")
    both = told.select(name.alias("node"), F.expr("substring(to, 2)").alias("root"), way.alias("way"), "downs", "ups").groupBy("node", "root").agg(*[F.max(F.when(F.col("way") == w, F.col(c))).alias(a) for w, c, a in (("+", "downs", "d"), ("+", "ups", "u"), ("-", "downs", "left"))])
    totals = both.where("node = root").select("root", F.col("d").alias("all_"))
    out = both.join(totals, "root").join(rows.select("node", "parent"), "node")
    return checkpointed(out.select("node", "parent", "root", (F.col("all_") - F.col("d")).alias("number"), (F.col("d") - F.col("left")).alias("size"), (F.col("u") - F.col("d")).cast("int").alias("depth")))


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (root, number, ...) with the sum of value up to and with each number, cells first summed by themselves."""
    cells = rows.withColumn("cell", F.floor(F.col("number") / CELL)).withColumn("value_", value)
    sums = cells.groupBy("root", "cell").agg(F.sum("value_").alias("sum_"))
    before = sums.select("root", "cell", (F.sum("sum_").over(W.partitionBy("root").orderBy("cell")) - F.col("sum_")).alias("before_"))
    inside = F.sum("value_").over(W.partitionBy("root", "cell").orderBy("number"))
    return cells.withColumn("inside_", inside).join(before, ["root", "cell"]).withColumn(name, F.col("inside_") + F.col("before_")).drop("cell", "value_", "inside_", "before_")


def pruned_totals(tour: DataFrame, values: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """node, total and n: the sum of values (node, value) in each node's sub-tree, and how many nodes are in it, without the
    sub-trees of cut (node). Nodes without a value count 0, those in cut sub-trees are left out."""
    rows = tour.join(values.groupBy("node").agg(F.sum("value").alias("value")), "node", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    if cut is not None:
        # a cut opens at its node and closes after its sub-tree
        ranges = tour.join(cut.select("node").distinct(), "node").select("root", F.inline(F.array(F.struct(F.col("number"), F.lit(1).alias("open")), F.struct((F.col("number") + F.col("size")).alias("number"), F.lit(-1).alias("open")))))
        opened = ranges.groupBy("root", "number").agg(F.sum("open").alias("open"))
        rows = running(rows.join(opened, ["root", "number"], "left"), F.coalesce("open", F.lit(0)), "within").withColumn("kept", F.col("within") == 0).drop("open", "within")
    else:
        rows = rows.withColumn("kept", F.lit(True))
    rows = checkpointed(running(running(rows, F.when(F.col("kept"), F.col("value")).otherwise(0), "sum"), F.col("kept").cast("long"), "count"))
    at = rows.select("root", F.col("number").alias("last"), F.col("sum").alias("sum2"), F.col("count").alias("count2"))
    own = F.when(F.col("kept"), F.col("value")).otherwise(0)
    return rows.where("kept").withColumn("last", F.col("number") + F.col("size") - 1).join(at, ["root", "last"]).select("node", (F.col("sum2") - F.col("sum") + own).alias("total"), (F.col("count2") - F.col("count") + 1).alias("n"))


def common_ancestors(tour: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, and others) with lca (null if they are in two trees), steps (edges between them) and above: whether a is b or is
    above it. Pairs with a node that no tree has are left out."""
    level = checkpointed(tour.select("root", "number", F.struct("depth", "parent").alias("least")))
    levels, k, largest = [level.withColumn("k", F.lit(0))], 0, tour.agg(F.max("size")).first()[0] or 0
    while 2 << k <= largest:
        right = level.select("root", (F.col("number") - (1 << k)).alias("number"), F.col("least").alias("other"))
        level, k = checkpointed(level.join(right, ["root", "number"]).select("root", "number", F.least("least", "other").alias("least"))), k + 1
        levels.append(level.withColumn("k", F.lit(k)))
    table = levels[0]
    for x in levels[1:]:
        table = table.unionByName(x)
    end = lambda c: tour.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("number").alias(f"at_{c}"), F.col("depth").alias(f"depth_{c}"), F.col("size").alias(f"size_{c}"))
    asked = checkpointed(pairs.withColumn("pair_", F.monotonically_increasing_id()).join(end("a"), "a").join(end("b"), "b"))
    low, high = F.least("at_a", "at_b"), F.greatest("at_a", "at_b")
    apart = asked.where("root_a = root_b and at_a <> at_b").select("pair_", F.col("root_a").alias("root"), low.alias("low"), high.alias("high"), F.floor(F.log2(high - low)).cast("int").alias("k"))
    spans = apart.select("pair_", "root", "k", F.explode(F.array(F.col("low") + 1, F.col("high") - F.expr("shiftleft(1, k)") + 1)).alias("number"))
    found = spans.join(table, ["root", "k", "number"]).groupBy("pair_").agg(F.min("least").alias("least"))
    out = asked.join(found, "pair_", "left")
    same = F.col("root_a") == F.col("root_b")
    lca = F.when(same, F.coalesce("least.parent", "a"))
    depth = F.coalesce(F.col("least.depth") - 1, F.col("depth_a"))
    above = same & (F.col("at_a") <= F.col("at_b")) & (F.col("at_b") < F.col("at_a") + F.col("size_a"))
    return out.select(*pairs.columns, lca.alias("lca"), F.when(same, F.col("depth_a") + F.col("depth_b") - 2 * depth).alias("steps"), above.alias("above"))
