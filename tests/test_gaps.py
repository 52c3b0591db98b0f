"""Ways over gaps in bulk against searches of one gap at a time."""

import random
from collections import defaultdict

import pytest

from synteny_spark.operators.gaps import gap_paths, widths
from synteny_spark.operators.linear import turn
from synteny_spark.operators.paths import Budget, Ways, chosen, strategies
from synteny_spark.operators.recon import both_ways, gap_edges

EDGE, GAP = "anc string, a int, sa int, b int, sb int, weight long", "anc string, gap string, x int, sx int, y int, sy int"
CODES = ["1", "2", "31", "32", "33", "34", "35", "36", "40", "41", "42", "431", "436", "44"]


@pytest.fixture(scope="module")
def case(spark):
    """Ten genes with ids of unknown strand among them, six of which are single; several weights tie, and edges repeat."""
    random.seed(5)
    side = lambda v: random.choice((0, 10)) if v == 9 else random.choice((1, 1, -1))
    rows = []
    for anc in ("A", "B"):
        for _ in range(26):
            a, b = random.sample(range(10), 2)
            rows.append((anc, min(a, b), side(min(a, b)), max(a, b), side(max(a, b)), random.randint(1, 5)))
    gaps = [(anc, f"{x}.{sx}-{y}.{sy}", x, sx, y, sy) for anc in ("A", "B") for x in range(4) for y in range(4) if x != y for sx in (1, -1) for sy in (1, -1)]
    inner = [(anc, g) for anc in ("A", "B") for g in range(4, 10)]
    return rows, gaps, inner, spark.createDataFrame(gaps, GAP), spark.createDataFrame(rows * 2, EDGE), spark.createDataFrame(inner + inner[:3], "anc string, id int")


def plain(rows, anc, start, end, must_extend=False):
    best = defaultdict(int)
    for c, a, sa, b, sb, w in rows:
        if c == anc:
            for x, y in (((a, sa), (b, sb)), (turn((b, sb)), turn((a, sa)))):
                best[x, y] = max(best[x, y], w)
    links = both_ways((x, y, w) for (x, y), w in best.items())
    singles = set(range(4, 10))
    common = [(w, x, y) for x, ys in links.items() if x[0] in singles for y, w in ys.items() if y[0] in singles]
    return gap_edges(start, end, links, singles, common, Ways(common), must_extend)


@pytest.mark.parametrize("must_extend", [False, True])
def test_paths_of_gaps(spark, case, must_extend):
    rows, gaps, _, g, e, i = case
    want = set()
    for anc, gap, x, sx, y, sy in gaps:
        if edges := plain(rows, anc, (x, sx), (y, sy), must_extend):
            for code in CODES:
                if path := chosen(strategies(f"0,{code}|10000")[0], len(edges))[0]((x, sx), (y, sy), edges, Budget()):
                    want.add((anc, gap, code, tuple(path[0]), tuple(path[1])))
    got = gap_paths(g, e, i, CODES, must_extend=must_extend).collect()
    assert not any(r.late for r in got) and len(got) == len(want) > 300
    assert {(r.anc, r.gap, r.code, tuple(zip(r.ids, r.strands)), tuple(r.weights)) for r in got} == want


def test_widths_of_gaps(spark, case):
    rows, gaps, _, g, e, i = case
    want = {}
    for anc, gap, x, sx, y, sy in gaps:
        edges = plain(rows, anc, (x, sx), (y, sy))
        for w in sorted({w for w, _, _ in edges}):
            if Ways(k for k in edges if k[0] >= w).leads((x, sx), (y, sy)):
                want[anc, gap] = w
    assert {(r.anc, r.gap): r.width for r in widths(g, e, i).collect()} == want and len(set(want.values())) > 2


def test_late_large_and_empty(spark, case):
    _, _, _, g, e, i = case
    late = gap_paths(g, e, i, ["31t"], steps=0).collect()
    assert late and all(r.late and r.ids is None for r in late)
    assert gap_paths(g, e, i, ["31"], most=1).count() == 0
    assert gap_paths(g.limit(0), e, i).count() == gap_paths(g, e.limit(0), i).count() == widths(g, e.limit(0), i).count() == 0
    assert all(len(r.ids) == 2 for r in gap_paths(g, e, i.limit(0)).collect())
