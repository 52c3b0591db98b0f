"""Kernels against hand-made cases and brute force."""

import random

import pytest

import plain_diagonals as diagonals
from synteny_spark.functions import numbers as fn
from synteny_spark.operators import genetrees, linear, paths, recon
from synteny_spark.operators.trees import SpeciesTree
from synteny_spark.plans.projection import TREE
from synteny_spark.sources import files, newick

P = lambda a, b, w: ((a, 1), (b, 1), w)
g = lambda i: (i, 1)


def forest(edges, shortcuts=False, least=0):
    graph = linear.accumulate(edges)
    if shortcuts:
        linear.remove_shortcuts(graph)
    return list(linear.paths(graph, linear.linear_forest(graph, least)[0]))


def test_linear_forest_by_hand():
    assert forest([P(0, 1, 3), P(1, 2, 2), P(0, 2, 1)]) == [([g(0), g(1), g(2)], [3, 2])]
    assert forest([P(0, 1, 3), P(1, 2, 3), ((0, -1), (2, -1), 1)]) == [([g(0), g(1), g(2)], [3, 3])]
    assert forest([P(0, 1, 2), P(1, 2, 2), P(0, 2, 3)], True) == [([g(0), g(1), g(2)], [2, 2])]
    assert forest([P(0, 1, 2), P(1, 2, 2), P(0, 2, 3)]) == [([g(0), g(2)], [3]), ([g(1)], [])]


def test_linear_forest_holds_its_promises():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(2, 12)
        edges = [((a, rng.choice((1, -1))), (b, rng.choice((1, -1))), rng.randint(1, 4)) for a, b in (rng.sample(range(n), 2) for _ in range(rng.randint(1, 25)))]
        found = forest(edges)
        seen = [v for p, _ in found for v, _ in p]
        assert len(seen) == len(set(seen)) and set(seen) == {x[0] for e in edges for x in e[:2]}
        mirrored = forest([(linear.turn(y), linear.turn(x), w) for x, y, w in edges])
        assert sorted(map(str, found)) == sorted(map(str, mirrored))


def test_turn_of_unknown_strand():
    assert linear.turn((3, 0)) == (3, 10) and linear.turn((3, 10)) == (3, 0)


CODES = ["1", "2", "31", "32", "33", "34", "35", "36", "40", "41", "42", "431", "432", "433", "434", "435", "436", "44"]


def found_by(code, start, end, edges):
    table, most = paths.strategies(f"0,{code}|100")
    assert most == 100
    return paths.chosen(table, len(edges))[0](start, end, edges, paths.Budget())


@pytest.mark.parametrize("code", CODES)
def test_path_searches_by_hand(code):
    edges = sorted([(w, x, y) for x, y, w in (P(0, 1, 1), P(1, 2, 1), P(2, 3, 1), P(0, 3, 5))], reverse=True)
    assert found_by(code, g(0), g(3), edges) == (([g(0), g(1), g(2), g(3)], [1, 1, 1]) if code == "32" else ([g(0), g(3)], [5]))
    assert found_by(code, g(0), g(9), edges) is None


def simple_paths(start, end, edges):
    """Every path from start to end that has no gene twice."""
    step, todo, out = {}, [([start], [])], []
    for w, x, y in edges:
        step.setdefault(x, []).append((y, w))
    while todo:
        nodes, ws = todo.pop()
        for y, w in step.get(nodes[-1], ()):
            if y == end:
                out.append((nodes + [y], ws + [w]))
            elif y[0] not in {n[0] for n in nodes} | {end[0]}:
                todo.append((nodes + [y], ws + [w]))
    return out


def test_path_searches_against_all_paths():
    """Random graphs of oriented genes. Every search gives one of the paths, or none if there is none; 31 to 33 of start's choices
    can be told from the enumeration, and 4x and 1, 2 by their weights taken from the heaviest on."""
    rng, some = random.Random(11), 0
    for _ in range(250):
        n = rng.randint(3, 6)
        nodes = [(i, s) for i in range(1, n) for s in (1, -1)]
        pairs = {}
        for _ in range(rng.randint(4, 24)):
            x, y = rng.choice([*nodes, (0, 1)]), rng.choice([*nodes, (n, 1)])
            if x[0] != y[0]:
                pairs[x, y] = rng.randint(1, 5)
        both = pairs | {(linear.turn(y), linear.turn(x)): w for (x, y), w in pairs.items() if x[0] and y[0] != n}
        edges = sorted(((w, x, y) for (x, y), w in both.items()), reverse=True)
        all_ = simple_paths((0, 1), (n, 1), edges)
        some += len(all_) > 1
        rank = {e[1:]: i for i, e in enumerate(edges)}
        ranks = lambda p: sorted(rank[x] for x in zip(p[0], p[0][1:]))  # noqa: B023, E731
        for code in CODES:
            p = found_by(code, (0, 1), (n, 1), edges)
            assert (p is None) == (not all_) or code[0] == "4", code
            assert p is None or p in all_, code
            if p and code in ("1", "2"):  # the first set of edges in the order of ranks
                assert ranks(p) == min(map(ranks, all_)), code
            if p and code in ("40", "42", "44", "431"):  # no path has a heavier lightest edge
                assert max(ranks(p)) == min(max(ranks(q)) for q in all_), code
    assert some > 60


def test_timed_search_gives_up():
    edges = [(1, g(a), g(b)) for a in range(9) for b in range(9) if a != b]
    with pytest.raises(paths.Exhausted):
        paths.strategies("0,32|100")[0][0][1](g(0), g(8), edges, paths.Budget(50))


def links(*edges):
    return recon.both_ways([P(*e) for e in edges])


def test_fill_in():
    block = [([g(0), g(3)], [4])]
    assert recon.fill(block, {1, 2}, links((0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1))) == ([([g(0), g(1), g(2), g(3)], [1, 1, 1])], set())
    assert recon.fill(block, {1, 2}, links((1, 2, 1), (2, 3, 1), (0, 3, 1))) == ([([g(0), g(3)], [1])], {1, 2})
    assert recon.fill(block, {1, 2}, links((1, 2, 1))) == ([([g(0), g(3)], [-4])], {1, 2})
    two = [([g(0), g(3)], [1]), ([g(5), g(6)], [1])]  # both want gene 1; the heavier gets it
    made, left = recon.fill(two, {1}, links((0, 1, 1), (1, 3, 1), (5, 1, 3), (1, 6, 3), (0, 3, 1), (5, 6, 1)))
    assert made == [([g(0), g(3)], [1]), ([g(5), g(1), g(6)], [3, 3])] and not left


def test_insertion():
    assert recon.insert([([g(0), g(1)], [1])], [([g(7)], [])], links((0, 7, 3))) == ([([g(0), g(7), g(1)], [3, 0])], [])
    assert recon.insert([([g(0), g(1)], [5])], [([g(7)], [])], links((0, 7, 3))) == ([([g(0), g(1)], [5])], [([g(7)], [])])
    assert recon.insert([([g(0), g(1)], [1])], [([g(7), g(8)], [2])], links((1, 7, 3)))[0] == [([g(0), g(1), g(7), g(8)], [1, 3, 2])]


def test_collinear_and_diagonals():
    a = {"1": [(0, 1), (1, 1), (2, -1), (9, 1)]}
    assert [d[4] for d in diagonals.diagonals(a, {"x": [(0, 1), (1, 1), (2, -1)]})] == [[0, 1, 2]]
    assert [d[4] for d in diagonals.diagonals(a, {"x": [(2, 1), (1, -1), (0, -1)]})] == [[0, 1, 2]]  # read backwards
    assert [d[4] for d in diagonals.diagonals(a, {"x": [(0, 1), (2, -1), (1, 1)]})] == [[0], [1], [2]]
    gap = {"x": [(0, 1), (7, 1), (1, 1)]}
    assert [d[4] for d in diagonals.diagonals({"1": [(0, 1), (1, 1)]}, gap, "all")] == [[0], [1]]
    assert [d[4] for d in diagonals.diagonals({"1": [(0, 1), (1, 1)]}, gap, "all", gap=1)] == [[0, 1]]


def plain_runs(genes, where, same_strand):
    """Runs told gene by gene from the pairs of places."""
    beside = lambda p, s, q, t: p[0] == q[0] and ((q[1], q[2] * t) == (p[1] + s * p[2], p[2] * s) if same_strand else abs(p[1] - q[1]) == 1)
    out, run = [], []  # of a run: gene, its places still open
    for i, (f, s) in enumerate(genes):
        mine = where.get(f, []) if f >= 0 else []
        pairs = [(p, q) for q in mine for p in (run[-1][1] if run else ()) if beside(p, genes[i - 1][1], q, s)]
        if pairs:
            run[-1] = (i - 1, [pairs[0][0]])
            run.append((i, [pairs[0][1]]))
        else:
            out.append(run)
            run = [(i, mine)]
    return [(r[-1][1][0][0], [(i, genes[i][1]) for i, _ in r], [p[0][1:] for _, p in r], [genes[i][0] for i, _ in r]) for r in [*out, run] if r and r[0][1]]


@pytest.mark.parametrize("same_strand", [True, False])
def test_collinear_runs_of_many_orthologs(same_strand):
    rng, long = random.Random(7), 0
    for _ in range(400):
        row = [(rng.randint(-1, 5), rng.choice((1, -1))) for _ in range(rng.randint(0, 25))]
        where = {}
        for c in "xy":
            other = [(f, s if rng.random() < 0.8 else -s) for f, s in row] if rng.random() < 0.6 else [(rng.randint(0, 5), rng.choice((1, -1))) for _ in range(12)]
            for k, (f, s) in enumerate(other if rng.random() < 0.5 else [(f, -s) for f, s in other[::-1]]):
                where.setdefault(f, []).append((c, k, s))
        got = [(c, list(a), list(b), list(f)) for c, a, b, f in diagonals.collinear(row, where, same_strand)]
        assert got == plain_runs(row, where, same_strand)
        long += any(len(f) > 3 for *_, f in got)
    assert long > 50


def test_block_adjacencies():
    extant = {"1": [(i, 1) for i in range(6)]}
    assert diagonals.block_adjacencies(extant, {1: [(0, 1), (1, 1), (2, 1)], 2: [(3, 1), (4, 1), (5, 1)]}) == [((1, 1), (2, 1))]
    assert diagonals.block_adjacencies(extant, {1: [(0, 1), (1, 1), (2, 1)], 2: [(5, -1), (4, -1), (3, -1)]}) == [((1, 1), (2, -1))]


def test_trees():
    t = SpeciesTree.read(TREE)
    assert (t.lca("M1", "M2"), t.lca("M1", "M3"), t.lca("M1", "M4")) == ("A3", "A1", "A0")
    assert t.path("M1", "M4") == ["M1", "A3", "A1", "A0", "A2", "M4"] and t.outgroup["A1"] == {"M4", "M5"} and t.age["A0"] == 10
    assert t.ancestor_targets("\\A3") == {"A3", "A1", "A0"} and t.ancestor_targets("/A1") == {"A0", "A2"} and t.ancestor_targets("A0,_=A0") == {"A1", "A2", "A3"}
    assert t.pairwise_targets("A0")[1] == {"A0", "A1", "A2", "A3"}
    with pytest.raises(ValueError):
        t.pairwise_targets("=A2", "=M1")
    assert t.subtree(["M1", "M3", "M4"]) == ("A0", {"A1": ["M1", "M3"], "A0": ["A1", "M4"]})
    assert newick.write(newick.parse("((a:1,b:2)c:3[&&NHX:S=x],d)e;")) == "((a:1,b:2)c:3[&&NHX:S=x],d:0)e:0;"
    table = SpeciesTree.read("A|old\t10\n\tB\t5\n\t\tx\t0\n\t\ty\t0\n\tz\t0")
    assert table.age["A"] == 10 and table.official("old") == "A" and table.length["B"] == 5
    assert SpeciesTree.read("(.a:1,*b:1)c;").coverage == {"c": "full", "a": "6X", "b": "2X"}


def gene_tree(dup=0):
    t = genetrees.GeneTree(0, "Fam", {0: [(1, 1), (2, 1)], 1: [(3, 1), (4, 1)], 3: [(5, 1), (6, 1)], 2: [(7, 1), (8, 1)]})
    t.taxon = {0: "A0", 1: "A1", 2: "A2", 3: "A3", 4: "M3", 5: "M1", 6: "M2", 7: "M4", 8: "M5"}
    t.dup = dict.fromkeys(t.taxon, 0) | {3: dup}
    t.gene = {n: f"g{n}" for n in (4, 5, 6, 7, 8)}
    return t


def test_families():
    s = SpeciesTree.read(TREE)
    found = {(a, n): m for a, n, m in genetrees.families_of(gene_tree(), s)}
    assert found["A0", "Fam"] == ["g5", "g6", "g4", "g7", "g8"] and found["A3", "Fam"] == ["g5", "g6"] and len(found) == 9
    found = {(a, n): m for a, n, m in genetrees.families_of(gene_tree(2), s)}
    assert found["A3", "Fam.a"] == ["g5"] and found["A3", "Fam.b"] == ["g6"] and found["A1", "Fam"] == ["g5", "g6", "g4"]


def test_constrained_families():
    s = SpeciesTree.read("((M1:1,M2:1)A3:1,M3:1)A1;")
    fams = {"A1": [(0, "f", ["a", "b", "c"])], "A3": [(0, "f", ["a", "b", "c"])], "M1": [(0, None, ["a"]), (1, None, ["b"])], "M2": [(0, None, ["c"])], "M3": []}
    kept = genetrees.constrain(fams, s, "A1", 0.0, 1.0)  # three genes in two species are too many
    assert kept["A1"] == [(0, "f", [])] and kept["A3"] == [(0, "f", [])]
    assert genetrees.constrain(fams, s, "A1", 0.0, 2.0)["A1"] == [(0, "f", ["a", "b", "c"])]


def test_tree_edits():
    s = SpeciesTree.read(TREE)
    t = gene_tree()
    t.children[0] = [(9, 1), (2, 1)]
    t.children[9] = [(1, 1)]
    t.taxon[9], t.dup[9] = "A1", 0
    assert genetrees.compact(t) and 1 not in t.taxon and t.children[9] == [(3, 2), (4, 2)]
    t.taxon[0] = "A1"
    assert genetrees.rename(t, s) and t.taxon[0] == "A0"
    flat = gene_tree()
    flat.taxon[1] = "A0"
    flat.children[0], flat.children[2] = [(1, 1), (7, 1)], []
    flat.children.pop(2)
    flat.children[1] = [(3, 1), (8, 1)]
    assert genetrees.flatten(flat, s) and flat.children[0] == [(3, 2), (8, 2), (7, 1)]
    assert genetrees.rebuild(flat, s, lambda *_: False) and [flat.taxon[c] for c, _ in flat.children[0]] == ["A3", "A2"]
    assert genetrees.edit_duplications(d := gene_tree(2), s, 0.3) and d.dup[3] == 0


def test_numbers():
    assert [fn.duplication_suffix(n) for n in (1, 26, 27, 28, 52)] == [".a", ".z", ".`b", ".ab", ".yb"] and fn.duplication_suffix(27, True) == ".@B"
    assert fn.codon_table()["ATG"] == "M" and fn.codons_of()["W"] == ["TGG"]
    assert fn.integer_root("2", 5) == "1.41421" and len(list(fn.partitions([1, 2, 3, 4]))) == 15
    assert fn.permutation_at("abc", 5) == ["c", "b", "a"] and fn.linear([(0, 0), (2, 4)])(1) == 2 and fn.cubic([(0, 0), (1, 1), (2, 2)])(1.5) == pytest.approx(1.5)


def test_sniffing():
    kinds = {">x": "grimm", "1 -2 $": "grimm", "f a b": "families", "1\tg1 g2": "chromosome_names", "1\t5\t9\t-1\tg": "genes", "1\t-1\t3 4\t1 1": "signed_chromosomes", "3 4\t1 -1": "chromosome_names", "3\t-1": "ids_strands", "A0\t8\t1 2\t1 1\t3": "blocks"}
    assert {k: files.sniff(k) for k in kinds} == kinds
    assert list(files.mysql_lines(["a\\\n", "b\t\\N\n"])) == [["ab", None]]
    assert list(files.typed_rows(["1\tx\t2\t3"], [int, str, (float, 2)])) == [(1, "x", 2.0, 3.0)]


def test_duplication_scores():
    s = SpeciesTree.read("(((M1:1,*M2:1)A3:1,M3:1)A1:1,(M4:1,*M5:1)A2:1)A0;")
    assert genetrees.duplication_cutoffs(s, 0.5)["A0"] == 0.5 and genetrees.duplication_cutoffs(s, {"A1": 0.4}, 3) == dict.fromkeys(s.species, 0.0) | {"A0": 0.0, "A1": 0.4, "A2": 0.0, "A3": 0.0}
    two = genetrees.duplication_cutoffs(s, 0.5, 2)
    assert two["A0"] == pytest.approx(round(1.5 / 5, 3) - 2e-3) and two["A3"] == pytest.approx(0.5 - 2e-3) and two["M1"] == 0
    t = genetrees.GeneTree(0, "F", {0: [(1, 1), (2, 1)], 1: [(3, 1), (4, 1)], 2: [(5, 1), (6, 1)]})
    t.taxon, t.dup = {0: "A3", 1: "A3", 2: "A3", 3: "M1", 4: "M2", 5: "M1", 6: "M1"}, dict.fromkeys(range(7), 0) | {0: 2}
    t.gene = {n: f"g{n}" for n in (3, 4, 5, 6)}
    assert t.confidence(0) == 0.5 and t.confidence(0, frozenset(["M2"])) == 1.0 and t.confidence(0, frozenset(["M1", "M2"])) == 0.0 and t.confidence(3) == 1.0
    import copy

    low, high = copy.deepcopy(t), copy.deepcopy(t)
    genetrees.edit_duplications(low, s, 0.6)
    genetrees.edit_duplications(high, s, 0.6, 3)
    assert low.dup[0] < genetrees.DUPLICATION <= high.dup[0]


def test_colours_and_coordinates():
    from synteny_spark.functions import colours

    assert colours.table(["! comment", "255 0 0\t\tred", "0 128 255 deep sky"]) == {"red": (1.0, 0.0, 0.0), "deep sky": (0.0, 128 / 255, 1.0)}
    assert colours.gradient([(0, 0, 0), (1, 1, 1)])(0.25) == (0.25, 0.25, 0.25) and colours.gradient([(0, 0, 0), (1, 0, 1), (1, 1, 1)], True)(0.5) == pytest.approx((1, 0, 1))
    assert colours.mixed((1, 0, 0), (0, 0, 1), 0.25) == (0.25, 0, 0.75) and colours.from_yuv(0.5, 0, 0) == pytest.approx((0.5, 0.5, 0.5))
    red = (0.299, -0.299 * 0.436 / 0.886, 0.615)
    assert colours.from_yuv(*red) == pytest.approx((1, 0, 0), abs=1e-9)
    assert fn.by_coordinate([(0, (0, 10)), (2, (4, 0))])(1) == [2, 5]


def test_species_lists():
    t = SpeciesTree.read(TREE)
    assert t.species_since("A3") == ["M1", "M2"] and t.species_before("A1") == ["M4", "M5"] and len(t.species_since("nowhere")) == 5 == len(t.species_before("nowhere"))
