"""Gaps of blocks, each searched by itself and all at once: how wide the way over a gap can be, and its path under a search's code.

gaps has anc, gap (unique in anc), x, sx, y and sy, the oriented ends; inner has anc and id, what a way may go over; edges are
anc, a, sa, b, sb and weight, and lead both ways. Rounds are joins of what was reached last with the edges at it, for all gaps
together, so there are as many as a way has steps, and no task holds a graph. Fill-in differs in that gaps contest for what they share.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synteny_spark.operators.grouped import per_group
from synteny_spark.operators.paths import Budget, Exhausted, chosen, deep, strategies
from synteny_spark.operators.spread import checkpointed, discard, spread_join


def turned(s: str) -> Column:
    """The strand from the other side; 0 and 10 are the sides of ids without one."""
    return F.when(F.col(s) == 0, 10).when(F.col(s) == 10, 0).otherwise(-F.col(s))


def arcs(edges: DataFrame) -> DataFrame:
    """anc, p, sp, q, sq, weight: the edges both ways, once each with the greatest weight."""
    names = ["anc", "p", "sp", "q", "sq", "weight"]
    back = edges.select("anc", "b", turned("sb"), "a", turned("sa"), "weight")
    both = edges.select("anc", "a", "sa", "b", "sb", "weight").union(back).toDF(*names)
    return both.groupBy(*names[:5]).agg(F.max("weight").cast("bigint").alias("weight"))


#: Rounds after which what is known so far is written as one table.
COMPACT = 8


def _reached(starts: DataFrame, ways: DataFrame, inner: DataFrame, wide: bool = False) -> DataFrame:
    """anc, gap, node, s, start: starts and all that they lead to; with wide, also the greatest least weight of a way there as width
    (none at starts). The way goes on from inner nodes only; others are reached and left. A node is met again only by a wider way, so
    the rounds end. Each round writes what is new."""
    ahead = checkpointed(ways.join(inner.select("anc", F.col("id").alias("q"), F.lit(True).alias("on")).distinct(), ["anc", "q"], "left"))
    place, beyond = ["anc", "gap", "node", "s"], F.lit((1 << 63) - 1)
    last = checkpointed(starts.select(*place, beyond.alias("width"), F.lit(True).alias("on"), F.lit(True).alias("start")))
    parts = [last]
    while not last.isEmpty():
        at = last.where("on").select("anc", "gap", F.col("node").alias("p"), F.col("s").alias("sp"), "width")
        width = F.least("width", "weight") if wide else F.lit(0).cast("bigint")
        step = spread_join(at, ahead, ["anc", "p", "sp"]).select("anc", "gap", F.col("q").alias("node"), F.col("sq").alias("s"), width.alias("width"), F.coalesce("on", F.lit(False)).alias("on"))
        best = step.groupBy(*place).agg(F.max("width").alias("width"), F.first("on").alias("on"))
        known = reduce(DataFrame.union, parts)
        had = known.groupBy(*place).agg(F.max("width").alias("had"))
        last = checkpointed(best.join(had, place, "left").where("had is null or width > had").drop("had").withColumn("start", F.lit(False)))
        parts.append(last)
        if len(parts) > COMPACT:
            whole = checkpointed(reduce(DataFrame.union, parts[:-1]))
            discard(*parts[:-1])
            parts = [whole, last]
    out = reduce(DataFrame.union, parts).groupBy(*place).agg(F.max("width").alias("width"), F.max("start").alias("start"))
    return out.withColumn("width", F.when(~F.col("start"), F.col("width")))


def widths(gaps: DataFrame, edges: DataFrame, inner: DataFrame) -> DataFrame:
    """anc, gap, width: with edges of that weight and more the ends still meet, with heavier ones alone they don't. Gaps whose ends
    never meet have no row. A way may use a gene twice, as the searches may not: a path's least weight is no greater."""
    met = _reached(gaps.select("anc", "gap", F.col("x").alias("node"), F.col("sx").alias("s")), arcs(edges), inner, True)
    ends = gaps.select("anc", "gap", F.col("y").alias("node"), F.col("sy").alias("s"))
    return met.join(ends, ["anc", "gap", "node", "s"]).where("not start").select("anc", "gap", "width")


def between(gaps: DataFrame, edges: DataFrame, inner: DataFrame, must_extend: bool = False) -> DataFrame:
    """anc, gap, p, sp, q, sq, weight: for each gap the edges that lie on a way between its ends, in that direction."""
    ways = checkpointed(arcs(edges))
    first = gaps.select("anc", F.concat(F.lit("f"), "gap").alias("gap"), F.col("x").alias("node"), F.col("sx").alias("s"))
    last = gaps.select("anc", F.concat(F.lit("b"), "gap").alias("gap"), F.col("y").alias("node"), turned("sy").alias("s"))
    singles = inner.select("anc", F.col("id").alias("node")).distinct()
    found = _reached(first.union(last), ways, inner)
    # Of what was reached, only starts and inner nodes are places on a way.
    inside = found.join(singles.withColumn("inner", F.lit(True)), ["anc", "node"], "left").where("start or inner")
    on = checkpointed(inside.select("anc", "gap", "node", "s", "start"))
    side = lambda mark: on.where(f"gap like '{mark}%'").withColumn("gap", F.expr("substr(gap, 2)"))
    tail = side("f").select("anc", "gap", F.col("node").alias("p"), F.col("s").alias("sp"), F.col("start").alias("at_x"))
    head = side("b").select("anc", "gap", F.col("node").alias("q"), turned("s").alias("sq"), F.col("start").alias("at_y"))
    own = spread_join(tail, ways, ["anc", "p", "sp"]).join(head, ["anc", "gap", "q", "sq"])
    return own.where(~(F.col("at_x") & F.col("at_y")) if must_extend else F.lit(True)).drop("at_x", "at_y")


def gap_paths(gaps: DataFrame, edges: DataFrame, inner: DataFrame, codes: Iterable[str] = ("32",), most: int = 10_000, steps: int = 200_000, must_extend: bool = False) -> DataFrame:
    """anc, gap, code, ids, strands, weights, late: each gap's path under each code of `paths.strategies` (a code with a t is timed). Gaps
    with as many edges as `most` aren't searched, as in fill-in; they have no row, nor have gaps without a path. late is true, and
    the path null, where a timed search used up its steps."""
    codes = list(codes)
    own = checkpointed(between(gaps, edges, inner, must_extend))
    large = own.groupBy("anc", "gap").count().where(F.col("count") >= most)
    ends = gaps.select("anc", "gap", F.col("x").alias("p"), F.col("sx").alias("sp"), F.col("y").alias("q"), F.col("sy").alias("sq"), F.lit(None).cast("bigint").alias("weight"))
    rows = own.unionByName(ends.join(own.select("anc", "gap").distinct(), ["anc", "gap"], "left_semi")).join(large, ["anc", "gap"], "left_anti")

    def kernel(group: list[tuple]) -> Iterable[tuple]:
        deep()
        anc, gap = group[0][:2]
        start, end = next(((p, sp), (q, sq)) for _, _, p, sp, q, sq, w in group if w is None)
        ranked = sorted(((w, (p, sp), (q, sq)) for _, _, p, sp, q, sq, w in group if w is not None), reverse=True)
        for code in codes:
            search, timed = chosen(strategies(f"0,{code}|{most}")[0], len(ranked))
            try:
                path = search(start, end, ranked, Budget(steps) if timed else Budget())
            except Exhausted:
                yield anc, gap, code, None, None, None, True
                continue
            if path:
                yield anc, gap, code, [v for v, _ in path[0]], [s for _, s in path[0]], path[1], False

    rows = rows.select("anc", "gap", "p", "sp", "q", "sq", "weight")
    return per_group(rows, ["anc", "gap"], kernel, "anc string, gap string, code string, ids array<int>, strands array<int>, weights array<bigint>, late boolean")
