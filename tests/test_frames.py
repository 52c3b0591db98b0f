"""DataFrame operators on small tables, readers and writers, whole workflows."""

import bz2
import lzma

import pytest
from pyspark.sql import functions as F

from synteny_spark.functions import columns as fc
from synteny_spark.operators import compare, components, filters, genetrees, joins, linear, stats, trees, windows
from synteny_spark.operators.trees import SpeciesTree
from synteny_spark.plans import workflow
from synteny_spark.plans.projection import TREE
from synteny_spark.sources import files, readers, sinks
from synteny_spark.streaming import pairs as stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_statistics(spark):
    df = spark.createDataFrame([("a", n) for n in (10, 5, 3, 1, 1)] + [("b", n) for n in (1, 2, 3, 4)] + [("c", None)], "k string, n int")
    assert {x: dict(rows(stats.nx(df, ["k"], "n", x)))["a"] for x in (50, 75, 25)} == {50: 10, 75: 5, 25: 10}
    q = {r.k: (r.q25, r.q50, r.q75) for r in stats.summary(df, ["k"], "n").collect()}
    assert q["b"] == (1, 2, 3) and q["c"] == (None, None, None)
    assert dict(rows(df.groupBy("k").agg(stats.weighted_average("n"))))["b"] == 3.0
    assert dict(rows(stats.summary(df, ["k"], "n").select("k", stats.summary_text())))["b"] == "1 [1/2/3] [2/3/4] 4 [2.50/1.12-4]"
    assert dict(rows(stats.summary(df, ["k"], "n").select("k", stats.short_summary_text())))["a"] == "min=1\tN50=10\tWA=6.80\tmax=10"
    assert stats.distribution_text({i: 1 for i in range(10)}, 2, 1) == "1:0, 1:1, ..., 1:9"
    assert rows(df.groupBy("k").agg(stats.quantile("n", 50)).where("k = 'b'")) == [("b", 2)]


def test_contigs_and_strands(spark):
    names = ["7", "150", "X", "7_random", "scaffold_3", "Un", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(fc.contig_type(F.col("n"))).collect()] == ["Chromosome", "Scaffold", "Chromosome", "Random", "Scaffold", "Unknown", "Unknown"]
    assert tuple(spark.range(1).select(fc.reverse_strand(F.lit(0)), fc.reverse_strand(F.lit(10)), fc.reverse_strand(F.lit(-1))).first()) == (10, 0, 1)
    assert tuple(spark.range(1).select(*fc.canonical_pair(F.lit(5), F.lit(1), F.lit(2), F.lit(-1))).first()) == (2, 1, 5, -1)


def test_adjacent_pairs_skip_copies(spark):
    g = spark.createDataFrame([("s", "c", i, f, 1) for i, f in enumerate([0, 1, 1, 2])], "genome string, chrom string, pos int, fam int, strand int")
    assert rows(windows.adjacent_pairs(g).select("f1", "f2")) == [(0, 1), (1, 2)]


def test_block_filters_keep_rows(spark):
    b = spark.createDataFrame([("A", i, n, list(range(n)), [1] * n, ["1"] * (n - 1)) for i, n in enumerate((10, 5, 3, 1, 1), 1)], linear.BLOCK)
    assert [r.n for r in filters.filter_blocks_fixed(b, 3).orderBy("block_id").collect()] == [10, 5, 3, 0, 0]
    out = filters.filter_blocks_proportional(b, 50).orderBy("block_id").collect()
    assert [r.n for r in out] == [10, 0, 0, 0, 0] and out[1].ids == []


def test_blocks_of_blocks(spark):
    inner = spark.createDataFrame([("A", 1, 2, [0, 1], [1, 1], ["5"]), ("A", 2, 2, [2, 3], [1, 1], ["6"])], linear.BLOCK)
    outer = spark.createDataFrame([("A", 1, 2, [2, 1], [-1, 1], ["9"])], linear.BLOCK)
    r = joins.expand_blocks(outer, inner).first()
    assert (r.ids, r.strands, r.support) == ([3, 2, 0, 1], [-1, -1, 1, 1], ["6", "9", "5"])
    assert joins.uncovered(outer, inner).isEmpty()


def test_range_join(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 25, 30)], "k int, beg long, end long")
    b = spark.createDataFrame([(1, 9, 12), (1, 10, 25), (1, 40, 41), (2, 0, 5)], "k int, beg2 long, end2 long")
    assert rows(filters.overlaps(a, b, "k", 20).select("beg", "beg2")) == [(0, 10), (0, 9), (25, 10)]


def test_components_and_labels(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    assert {r.component for r in components.components(chain).collect()} == {0, 100}
    o = spark.createDataFrame([(1, 101), (2, None), (None, 103), (4, 104), (5, 104), (6, 106), (6, 107), (8, 108), (8, 109), (9, 109)], "gene1 long, gene2 long")
    assert sorted(r.label for r in compare.gene_diff(o).collect()) == ["**", "+", "++", "-", "--", "="]


def test_readers(spark, tmp_path):
    (tmp_path / "g.bz2").write_bytes(bz2.compress(b"# c\n1\t5\t9\t-1\tg1 h1\n1\t1\t3\tNone\tg0\nX\t1\t2\t1\tg2\n"))
    (tmp_path / "g.xz").write_bytes(lzma.compress(b"1 -2 3 $\n4 $\n"))
    got = readers.read_genome(spark, str(tmp_path / "g.bz2"), "M1").orderBy("chrom", "idx").collect()
    assert [(r.chrom, r.idx, r.strand, r.names) for r in got] == [("1", 0, None, ["g0"]), ("1", 1, -1, ["g1", "h1"]), ("X", 0, 1, ["g2"])]
    assert rows(readers.read_genome(spark, str(tmp_path / "g.xz"), "M1").select("chrom", "strand", F.col("names")[0])) == [("1", -1, "2"), ("1", 1, "1"), ("1", 1, "3"), ("2", 1, "4")]
    (tmp_path / "b").write_text("A0\t2\t1 2\t1 -1\t7\nA0\t0\t\t\t\nA0\t1\t5\t1\t(1)\n")
    b = readers.read_blocks(spark, str(tmp_path / "b")).orderBy("block_id").collect()
    assert [(r.block_id, r.n, r.ids, r.support) for r in b] == [(1, 2, [1, 2], ["7"]), (2, 0, [], []), (3, 1, [5], ["(1)"])]
    (tmp_path / "f").write_text("f1 a b\nf2\n")
    assert rows(readers.read_families(spark, str(tmp_path / "f"), "A0")) == [("A0", 0, "f1", ["a", "b"]), ("A0", 1, "f2", [])]
    (tmp_path / "s.fa").write_text(">x\nacgt\nac\n>y\nTT\n")
    assert rows(files.fasta(spark, str(tmp_path / "s.fa"))) == [("x", "ACGTAC"), ("y", "TT")]
    (tmp_path / "t.nhx").write_text("((a:1[&&NHX:S=M1],b:1[&&NHX:S=M2]):1[&&NHX:S=A3:D=Y],c:1[&&NHX:S=M3])[&&NHX:S=A1];\n")
    forest = readers.read_forest(spark, str(tmp_path / "t.nhx"))
    assert forest.count() == 5 and forest.where("dup = 2").first().taxon == "A3"
    assert sinks.forest_lines(forest).first().value.startswith("((a:1")
    (tmp_path / "bad").write_text("1\t2\n")
    with pytest.raises(Exception, match="(?i)malformed|schema"):
        readers.read_adjacencies(spark, str(tmp_path / "bad"), "A0").collect()


def test_writers(spark, tmp_path):
    b = spark.createDataFrame([("A0", 2, 1, [5], [1], []), ("A0", 1, 2, [1, 2], [1, -1], ["7"])], linear.BLOCK)
    sinks.text_files(sinks.block_lines(b), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o") + "/anc=A0").collect()] == ["A0\t2\t1 2\t1 -1\t7", "A0\t1\t5\t1\t"]
    sinks.by_ancestor(b, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_groups(spark):
    tree = SpeciesTree.read(TREE)
    genes = spark.createDataFrame([("M1", "a"), ("M2", "a"), ("M4", "a"), ("M1", "b")], "species string, name string")
    groups = spark.createDataFrame([("A3", 1, ["a"]), ("A3", 2, ["b", "zz"])], "anc string, line int, members array<string>")
    assert rows(genetrees.ingest_groups(groups, genes, tree.closure(spark))) == [("A3", 0, "A3.1", ["M1.a", "M2.a"]), ("A3", 1, "A3.2", ["M1.b"])]


@pytest.fixture(scope="module")
def world(spark):
    """Two chromosomes of six genes, the same in five species but for an inversion in M3."""
    tree = SpeciesTree.read(TREE)
    genes, families = [], []
    for s in tree.species:
        for c in range(2):
            order = list(range(6 * c, 6 * c + 6))
            strand = dict.fromkeys(order, 1)
            if s == "M3" and c:
                order[2:4] = order[3:1:-1]
                strand |= dict.fromkeys(order[2:4], -1)
            genes += [(s, f"c{c}", i, f"{s}_{f}", strand[f]) for i, f in enumerate(order)]
    for a in tree.ancestors:
        families += [(a, f, f"F{f}", [f"{s}_{f}" for s in sorted(tree.leaves[a])]) for f in range(12)]
    for s in tree.species:
        families += [(s, f, None, [f"{s}_{f}"]) for f in range(12)]
    return tree, spark.createDataFrame(genes, "species string, chrom string, idx int, name string, strand int"), spark.createDataFrame(families, "anc string, fam_idx int, name string, members array<string>")


@pytest.mark.parametrize("preset", [workflow.basic, workflow.vertebrates])
def test_workflow(world, preset, tmp_path):
    r = workflow.Reconstruction(*world, folder=str(tmp_path))
    out = preset(r).table
    sizes = rows(out.groupBy("anc", "block").count())
    assert sizes == sorted([(a, b, 6) for a in ("A0", "A1", "A2", "A3") for b in ("CAR_1", "CAR_2")], key=str)
    assert rows(out.where("anc = 'A0' and block = 'CAR_1'").select("beg", "names"))[0] == (0, "F0 M1_0 M2_0 M3_0 M4_0 M5_0")
    again = workflow.Reconstruction(*world, folder=str(tmp_path))
    assert preset(again).key == preset(r).key and "pairs/all" in r.graph()


def test_two_passes(world):
    r = workflow.Reconstruction(*world, target="=A0")
    out = workflow.generic(r, sizes=[(1.0, 1.0)], cuts=[("fixedLength", 2)]).table
    assert out.count() == 12 and out.select("names").distinct().count() == 12


def test_workflow_file(world):
    r = workflow.Reconstruction(*world, target="=A1")
    text = "> AncGenes\nall = all\n1 = 1.0 1.0  # all species, once\n> Pairwise\nall = conservedPairs\n1 = conservedPairs\n> Integration\ndenovo (1) > first\nfillin (all)\nfusion +onlySingletons (all)\ninsertion (all)\nscaffolds < first\n[/out] publish\n"
    kept = workflow.run_ini(r, text.splitlines())
    assert kept["first"].table.where("n = 6").count() == 2
    with pytest.raises(ValueError):
        workflow.run_ini(r, ["> Integration", "melt (all)"])


def test_steps_of_other_inputs_are_not_reused(world, tmp_path):
    """The same folder with other genes, then with another tree."""
    tree, genes, families = world
    count = lambda *w: workflow.Reconstruction(*w, folder=str(tmp_path)).pairs(workflow.Reconstruction(*w, folder=str(tmp_path)).families).table.count()
    first = count(tree, genes, families)
    assert count(tree, genes.where("idx < 3"), families) < first
    assert count(tree, genes, families.where("fam_idx < 4")) < first and count(tree, genes, families) == first
    other = SpeciesTree.read("((((M1:10,M2:10)A3:0,M3:10)A1:0,M4:10)A2:0,M5:10)A0;")
    assert workflow.Reconstruction(other, genes, families, folder=str(tmp_path)).families.key != workflow.Reconstruction(tree, genes, families, folder=str(tmp_path)).families.key


def test_workflow_file_with_targets(world):
    r = workflow.Reconstruction(*world)
    text = "> AncGenes\nall = all\n1,2 = 1.0 1.0, 0.5 2.0\n> Pairwise\nall = conservedPairs\n1 = conservedPairs\n2 = conservedPairs\n> Integration\ndenovo (1) ! =A1\n[/mixed/] copy\ndenovo (2) ! =A0,=A2\n[/mixed/] copy\nfillin (all) ! A0\n[more] insertion -selectionFunction=newscore^-^oldscore (all)\n"
    steps = workflow.run_ini(r, text.splitlines())
    assert {"blocks/denovo-size-1.0-1.0", "blocks/mixed", "blocks/mixed.fillin-all", "blocks/mixed.fillin-all.more-all"} <= set(steps)
    ancestors = lambda k: {x.anc for x in steps[k].table.select("anc").distinct().collect()}
    assert ancestors("blocks/denovo-size-1.0-1.0") == {"A1"} and ancestors("blocks/mixed") == {"A0", "A1", "A2"}
    assert ancestors("blocks/mixed.fillin-all") == {"A0", "A1", "A2", "A3"}  # all ancestors below A0, A3 with singletons alone
    assert r.accounting().where("seconds > 0").count() >= 8


def test_stream(spark, tmp_path):
    g = spark.createDataFrame([("s", "c", i, f, 1) for i, f in enumerate([0, 1, 2])], "genome string, chrom string, pos int, fam int, strand int")
    g.write.parquet(str(tmp_path / "in"))
    q = stream.follow(spark.readStream.schema(g.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert stream.totals(spark.read.parquet(str(tmp_path / "out"))).count() == 2


def test_pair_paths(spark):
    tree = SpeciesTree.read(TREE)
    leaves = tree.closure(spark).where("desc like 'M%'")
    assert rows(trees.pair_paths(leaves)) == sorted([(x, y, a) for x in tree.species for y in tree.species if x < y for a in tree.path(x, y)[1:-1]], key=str)


@pytest.mark.parametrize("how", ["trees", "families", "groups"])
def test_command_line(spark, world, tmp_path, how):
    from synteny_spark.__main__ import main

    tree, genes, families = world
    (tmp_path / "tree.nwk").write_text(TREE)
    bare = how == "groups"
    for s in tree.species:
        name = (lambda n: n.split("_")[1]) if bare else str
        lines = [f"{r.chrom}\t{r.idx}\t{r.idx + 1}\t{r.strand}\t{name(r.name)}" for r in genes.where(F.col("species") == s).collect()]
        (tmp_path / f"genes.{s}").write_text("\n".join(lines) + "\n")
    for a in tree.ancestors:
        fs = families.where(F.col("anc") == a).orderBy("fam_idx").collect()
        (tmp_path / f"fam.{a}").write_text("".join(f"{r.name} {' '.join(r.members)}\n" for r in fs))
        (tmp_path / f"og.{a}").write_text("".join(f"{r.fam_idx}\n" for r in fs))
    text = "(((M1_{0}[&&NHX:S=M1],M2_{0}[&&NHX:S=M2])[&&NHX:S=A3],M3_{0}[&&NHX:S=M3])[&&NHX:S=A1],(M4_{0}[&&NHX:S=M4],M5_{0}[&&NHX:S=M5])[&&NHX:S=A2])[&&NHX:S=A0];\n"
    (tmp_path / "forest").write_text("".join(text.format(f) for f in range(12)))
    given = {"trees": "forest", "families": "fam.%s", "groups": "og.%s"}[how]
    main([str(tmp_path / "tree.nwk"), "--genes", str(tmp_path / "genes.%s"), f"--{how}", str(tmp_path / given), "--preset", "basic", "--out", str(tmp_path / "out")])
    (made,) = (tmp_path / "out/genomes").iterdir()
    lines = [r.value.split("\t") for r in spark.read.text(str(made)).where("anc = 'A0'").collect()]
    assert sorted(x[0] for x in lines) == ["CAR_1"] * 6 + ["CAR_2"] * 6 and "pairs/all" in (tmp_path / "out/steps.dot").read_text()


def test_lines_of_many_stretches(spark, tmp_path):
    """A file that is read in many pieces, and several files at once: lines are numbered in their order, blank ones too."""
    lines = [f"line {i} {'x' * (i % 50)}" if i % 7 else "" for i in range(3000)]
    (tmp_path / "long").write_text("\n".join(lines) + "\n")
    (tmp_path / "longer").write_text("only one")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.text_lines(spark, str(tmp_path / "long*")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r.value for r in sorted((r for r in got if r.path.endswith("long")), key=lambda r: r.line)] == lines
    assert sorted(r.line for r in got if r.path.endswith("long")) == list(range(3000)) and [(r.line, r.value) for r in got if r.path.endswith("longer")] == [(0, "only one")]


def test_natural_keys_of_long_numbers(spark):
    names = ["a2", "a10", "a" + "9" * 20, "a1" + "0" * 20, "a2" + "0" * 20, "a1" + "0" * 21, "b1", "a"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(fc.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["a", "a2", "a10", "a" + "9" * 20, "a1" + "0" * 20, "a2" + "0" * 20, "a1" + "0" * 21, "b1"]


def in_parts(spark, lines, anc, path):
    """The folder of one ancestor's lines, written by several tasks."""
    sinks.text_files(lines, str(path))
    assert len(spark.read.text(f"{path}/anc={anc}").inputFiles()) > 1
    return f"{path}/anc={anc}"


@pytest.fixture
def several_parts(spark):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_blocks_of_several_part_files(spark, tmp_path, several_parts):
    """Lines are numbered on from file to file of a folder that Spark wrote."""
    b = spark.createDataFrame([("A0", k, 1, [k], [1], []) for k in range(1, 41)], linear.BLOCK)
    path = in_parts(spark, sinks.block_lines(b), "A0", tmp_path / "b")
    assert sorted((r.block_id, r.ids) for r in readers.read_blocks(spark, path).collect()) == [(k, [k]) for k in range(1, 41)]


def test_families_of_several_part_files(spark, tmp_path, several_parts):
    fams = spark.createDataFrame([("A", k, f"f{k}", [f"g{k}"]) for k in range(40)], "anc string, fam_idx int, name string, members array<string>")
    read = readers.read_families(spark, in_parts(spark, sinks.family_lines(fams), "A", tmp_path / "f"), "A")
    assert rows(read) == rows(fams)


def test_groups_of_several_part_files(spark, tmp_path, several_parts):
    lines = spark.createDataFrame([("A", k, f"g{k} h{k}") for k in range(40)], "anc string, ord int, value string")
    read = readers.read_groups(spark, in_parts(spark, lines, "A", tmp_path / "g"), "A")
    assert sorted((r.line, r.members) for r in read.collect()) == [(k + 1, [f"g{k}", f"h{k}"]) for k in range(40)]


def test_trees_of_several_part_files(spark, tmp_path, several_parts):
    lines = spark.createDataFrame([("F", k, f"(a{k}:1[&&NHX:S=M1],b{k}:1[&&NHX:S=M2])[&&NHX:S=A3];") for k in range(40)], "anc string, ord int, value string")
    read = readers.read_forest(spark, in_parts(spark, lines, "F", tmp_path / "t"))
    assert sorted((r.tree_id, r.gene_name) for r in read.where("gene_name is not null").collect()) == sorted((k, f"{c}{k}") for k in range(40) for c in "ab")


@pytest.mark.parametrize("tile", [2, 4000])
def test_ortholog_pairs_are_told_once(spark, monkeypatch, tile):
    """Genes that share several families and names, tiles of keys, and no distinct over pairs."""
    monkeypatch.setattr(joins, "TILE", tile)
    side = lambda a: [(a + k, [f"p{k % 4}", f"q{k % 3}", f"r{k % 2}", None]) for k in range(12)] + [(a + 50, [f"only{a}"]), (a + 51, [])]
    left, right = side(0), side(100)
    fams = [("A", 0, "f0", ["p0", "p1", "q0"]), ("A", 1, "f1", ["p1", "q0", "q1"])]
    of = lambda names: {("f", i) for _, i, _, m in fams for n in names if n in m} | {n for n in names if n}
    want = {(a, b) for a, x in left for b, y in right if of(x) & of(y)}
    l, r = (spark.createDataFrame(s, "gene long, names array<string>") for s in (left, right))
    f = spark.createDataFrame(fams, "anc string, fam_idx int, name string, members array<string>")
    found = joins.orthologs(l, r, f)
    assert rows(found) == sorted(want, key=str)
    assert rows(joins.orthologs(l, r, f, gaps=True)) == sorted([*want, (50, None), (51, None)], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")
