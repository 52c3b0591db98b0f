"""The registered queries over the test tables, each with the SQL that gives the same rows in DuckDB, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synteny_spark.functions import columns as fc
from synteny_spark.operators import evidence, filters, joins, stats, windows
from synteny_spark.operators.spread import checkpointed, scratch
from synteny_spark.operators.trees import SpeciesTree, closure_of
from synteny_spark.plans import planted
from synteny_spark.plans import projection as pr
from synteny_spark.plans.projection import BLOCKS, GENES, PAIRS, TREE, blocks, genes, table
from synteny_spark.sources import files, readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def values(sql_rows: str, columns: str) -> str:
    return f"(VALUES {sql_rows}) AS v({columns})"


# Genomes and predicates


@query(f"WITH {GENES} SELECT CAST(sp AS BIGINT) sp, chrom, CAST(pos AS BIGINT) pos, CAST(fam AS BIGINT) fam, CAST(strand AS BIGINT) strand FROM g")
def gene_projection(spark, sf):
    return genes(spark, sf).select(*big("sp", "chrom", "pos", "fam", "strand"))


NAMES = "SELECT DISTINCT name FROM (SELECT c_mktsegment AS name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR) || '_random' FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT 'Un')"


KIND = f"""SELECT name, CASE WHEN name IN ('Un_random','UNKN','Un') THEN 'Unknown' WHEN regexp_matches(name, '^[0-9]+$') THEN CASE WHEN TRY_CAST(name AS BIGINT) < 100 THEN 'Chromosome' ELSE 'Scaffold' END
  WHEN contains(lower(name),'rand') THEN 'Random' WHEN regexp_matches(lower(name), 'cont|scaff|ultra|reftig|_|un|gl|ki|jh|aaex|aadn') OR name IN ('U','E64','2-micron') OR ends_with(name,'Het') THEN 'Scaffold' ELSE 'Chromosome' END AS kind FROM ({NAMES})"""
NAMES_CTE = f"n AS ({KIND})"


@query(KIND)
def contig_class(spark, sf):
    c, n, r, p = (table(spark, sf, t) for t in ("customer", "nation", "region", "part"))
    key = F.col("c_custkey").cast("string")
    parts = [c.select(F.col("c_mktsegment").alias("name")), n.select("n_name"), r.select("r_name"), c.select(key), c.select(F.concat(key, F.lit("_random"))), p.select("p_brand"), spark.createDataFrame([("Un",)], "name string")]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.distinct().select("name", fc.contig_type(F.col("name")).alias("kind"))


@query(f"WITH {GENES} SELECT chrom, pos, fam FROM g WHERE pkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def genome_filter_in(spark, sf):
    named = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("pkey"))
    return filters.keep_named(genes(spark, sf), named, "pkey").select("chrom", F.col("pos").cast("bigint").alias("pos"), "fam")


@query(f"WITH {GENES} SELECT chrom, pos, fam FROM g WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size < 10 AND p_partkey = pkey)")
def genome_filter_out(spark, sf):
    named = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("pkey"))
    return filters.drop_named(genes(spark, sf), named, "pkey").select("chrom", F.col("pos").cast("bigint").alias("pos"), "fam")


@query(f"WITH {GENES} SELECT chrom, pos, fam FROM (SELECT *, count(*) OVER (PARTITION BY chrom) k FROM g) WHERE k >= 5")
def min_chrom_size(spark, sf):
    return filters.min_chromosome_size(genes(spark, sf), 5, ["chrom"]).select("chrom", F.col("pos").cast("bigint").alias("pos"), "fam")


@query(f"WITH {GENES} SELECT chrom, fam, pos - 1 AS orig_idx, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx FROM g WHERE fam % 3 <> 0")
def reindex_kept(spark, sf):
    return filters.reindex(genes(spark, sf), F.col("fam") % 3 != 0, ["chrom"]).select("chrom", "fam", *big("orig_idx", "idx"))


HOUR = 3_600_000_000


@query(f"""SELECT x.event_id AS event_id, count(y.event_id) AS n FROM events x JOIN events y ON x.user_id = y.user_id AND epoch_us(y.ts) <= epoch_us(x.ts) + {HOUR} AND epoch_us(y.ts) + {HOUR} >= epoch_us(x.ts) GROUP BY 1""")
def range_overlap(spark, sf):
    e = pr.interval_events(spark, sf).withColumn("end", F.col("beg") + HOUR)
    right = e.select("user_id", F.col("event_id").alias("other"), F.col("beg").alias("beg2"), F.col("end").alias("end2"))
    return filters.overlaps(e, right, "user_id", HOUR).groupBy("event_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id FROM events WHERE user_id = 7 AND epoch_us(ts) >= 1704067200000000 AND epoch_us(ts) <= 1706745600000000""")
def genes_in_interval(spark, sf):
    e = pr.interval_events(spark, sf).select("event_id", F.col("user_id").alias("chrom"), "beg", F.col("beg").alias("end"))
    return filters.genes_at(e, 7, 1704067200000000, 1706745600000000).select("event_id", F.col("chrom").alias("user_id"))


@query("SELECT event_id, array_to_string(list(CAST(event_id AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS near FROM events")
def neighbourhood(spark, sf):
    out = windows.near(table(spark, sf, "events").withColumn("id", F.col("event_id").cast("string")), ["user_id"], ["ts", "event_id"], "id", 2)
    return out.select("event_id", F.array_join("near", ",").alias("near"))


@query("SELECT p_brand || '.' || p_name AS name, p_partkey FROM part")
def rename_unique(spark, sf):
    return filters.unique_names(table(spark, sf, "part"), "p_brand", "p_name").select(F.col("p_name").alias("name"), "p_partkey")


# Orthologs


ORTHO = GENES + """, l AS (SELECT DISTINCT chrom * 100 + pos AS gene, pkey, fam FROM g WHERE sp = 1), r AS (SELECT DISTINCT chrom * 100 + pos AS gene, pkey, fam FROM g WHERE sp = 2),
o AS (SELECT l.gene gene1, r.gene gene2 FROM l JOIN r ON l.fam = r.fam)"""


def _sides(spark, sf):
    """Genes of two genomes and the families of all parts; equal parts are of one family."""
    g, parts = genes(spark, sf), table(spark, sf, "lineitem").select("l_partkey").distinct()
    g = g.select("sp", (F.col("chrom") * 100 + F.col("pos")).alias("gene"), F.array(F.concat(F.lit("p"), F.col("pkey"))).alias("names"))
    fams = parts.groupBy((F.col("l_partkey") % 200).cast("int").alias("fam_idx")).agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey"))).alias("members")).select(F.lit("A").alias("anc"), "fam_idx", F.concat(F.lit("f"), "fam_idx").alias("name"), "members")
    return g.where("sp = 1").drop("sp"), g.where("sp = 2").drop("sp"), fams


@query(f"WITH {ORTHO} SELECT gene1, gene2 FROM o")
def ortholog_table(spark, sf):
    return joins.orthologs(*_sides(spark, sf))


@query(f"WITH {ORTHO} SELECT d.gene AS gene1, gene2 FROM (SELECT DISTINCT gene FROM l) d LEFT JOIN o ON o.gene1 = d.gene")
def ortholog_table_gaps(spark, sf):
    return joins.orthologs(*_sides(spark, sf), gaps=True)


@query(f"WITH {GENES} SELECT chrom, pos, fam FROM g WHERE sp = 1")
def translate_families(spark, sf):
    left, _, fams = _sides(spark, sf)
    out = joins.translate(left.select("gene", F.col("names")[0].alias("name")), fams)
    return out.select(F.floor(F.col("gene") / 100).cast("bigint").alias("chrom"), (F.col("gene") % 100).cast("bigint").alias("pos"), F.col("fam").cast("bigint").alias("fam"))


@query(f"WITH {GENES}, x AS (SELECT DISTINCT 'p' || pkey AS name FROM g WHERE sp = 2 AND strand = -1) SELECT DISTINCT chrom, pos FROM g JOIN x ON x.name = 'p' || pkey WHERE sp = 1")
def gene_positions(spark, sf):
    """Places in one genome of the genes that the other has read backwards."""
    g = genes(spark, sf)
    names = F.concat(F.lit("p"), F.col("pkey"))
    here = g.where("sp = 1").select(F.lit("M1").alias("genome"), "chrom", F.col("pos").alias("idx"), F.array(names).alias("names"))
    return joins.positions(here, g.where("sp = 2 and strand = -1").select(names.alias("name"))).select("chrom", F.col("idx").cast("bigint").alias("pos"))


COMMON = """y AS (SELECT l_suppkey % 3 AS sp, l_orderkey AS chrom, l_linenumber AS pos, l_partkey AS fam FROM lineitem),
f1 AS (SELECT * FROM y WHERE sp IN (1, 2) AND fam IN (SELECT fam FROM y WHERE sp = 1 INTERSECT SELECT fam FROM y WHERE sp = 2)), c1 AS (SELECT * FROM f1 QUALIFY count(*) OVER (PARTITION BY sp, chrom) >= 2)"""


def _rounds(n: int) -> str:
    """The next rounds of the fixed point: families of both, then chromosomes of two such genes."""
    return ", ".join(f"f{i} AS (SELECT * FROM c{i - 1} WHERE fam IN (SELECT fam FROM c{i - 1} WHERE sp = 1 INTERSECT SELECT fam FROM c{i - 1} WHERE sp = 2)), c{i} AS (SELECT * FROM f{i} QUALIFY count(*) OVER (PARTITION BY sp, chrom) >= 2)" for i in range(2, n + 1))


@query(f"WITH {COMMON}, {_rounds(12)} SELECT sp, chrom, pos, fam FROM c12")
def common_families(spark, sf):
    """Genes of families that two genomes share, on chromosomes that keep two of them, to the fixed point."""
    y = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("sp"), F.col("l_orderkey").alias("chrom"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("fam"))
    return joins.common_families(y.withColumn("genome", F.col("sp").cast("string")), "1", "2", 2).select("sp", "chrom", F.col("pos").cast("bigint").alias("pos"), "fam")


# Adjacency and evidence


@query(f"WITH {PAIRS} SELECT sp, chrom, a, CAST(sa AS BIGINT) sa, b, CAST(sb AS BIGINT) sb, count(*) AS n FROM c GROUP BY ALL")
def adjacent_pairs(spark, sf):
    pairs = windows.canonical(windows.adjacent_pairs(genes(spark, sf), ["sp", "chrom"]), ["sp", "chrom"])
    return pairs.groupBy("sp", "chrom", "a", "sa", "b", "sb").agg(F.count("*").alias("n")).select("sp", "chrom", "a", F.col("sa").cast("bigint").alias("sa"), "b", F.col("sb").cast("bigint").alias("sb"), "n")


WEIGHT = PAIRS + """, w AS (SELECT a, sa, b, sb, CASE WHEN sp IN (1,2,3) THEN 1 ELSE 2 END grp, count(*) n FROM c GROUP BY 1,2,3,4,5),
r AS (SELECT a, sa, b, sb, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) weight FROM w GROUP BY 1,2,3,4)"""


def _adjacency(spark, sf) -> DataFrame:
    pairs = windows.canonical(windows.adjacent_pairs(genes(spark, sf), ["sp", "chrom"]), ["sp"])
    counts = pairs.groupBy("a", "sa", "b", "sb", F.when(F.col("sp").isin(1, 2, 3), 1).otherwise(2).alias("grp")).agg(F.count("*").alias("n"))
    return windows.evidence_weight(counts).where("weight > 0")


@query(f"WITH {WEIGHT} SELECT a, sa, b, sb, weight FROM r WHERE weight > 0")
def conserved_adjacency(spark, sf):
    """The flagship: oriented adjacencies with the number of comparisons between groups that support them."""
    return _adjacency(spark, sf)


CHILD = values("('A0',1,'A1'),('A0',2,'A1'),('A0',3,'A1'),('A0',4,'A2'),('A0',5,'A2'),('A1',1,'A3'),('A1',2,'A3'),('A1',3,'M3'),('A2',4,'M4'),('A2',5,'M5'),('A3',1,'M1'),('A3',2,'M2')", "anc, sp, child")


@query(f"WITH {PAIRS} SELECT anc, a, CAST(sa AS INTEGER) sa, b, CAST(sb AS INTEGER) sb FROM c JOIN {CHILD} USING (sp) GROUP BY ALL HAVING count(DISTINCT child) >= 2")
def conserved_by_ancestor(spark, sf):
    below = SpeciesTree.read(TREE).closure(spark).where("desc like 'M%' and via is not null").select("anc", F.substring("desc", 2, 9).cast("bigint").alias("sp"), F.col("via").alias("child"))
    pairs = windows.canonical(windows.adjacent_pairs(genes(spark, sf), ["sp", "chrom"]), ["sp"]).distinct()
    return evidence.conserved(pairs.join(F.broadcast(below), "sp"))


LINEAGE = values("('A3',1,'M1',1),('A1',1,'A3',2),('A0',1,'A1',3),('A3',2,'M2',1),('A1',2,'A3',2),('A0',2,'A1',3),('A1',3,'M3',1),('A0',3,'A1',2),('A2',4,'M4',1),('A0',4,'A2',2),('A2',5,'M5',1),('A0',5,'A2',2)", "anc, sp, child, rk")
BELOW = values("('A0','A0'),('A0','A1'),('A0','A2'),('A0','A3'),('A1','A1'),('A1','A3'),('A2','A2'),('A3','A3')", "anc, target")
GROUPS = values("('A0',1,1),('A0',2,1),('A0',3,1),('A0',4,2),('A0',5,2),('A1',1,1),('A1',2,1),('A1',3,2),('A1',4,-1),('A1',5,-1),('A2',1,-1),('A2',2,-1),('A2',3,-1),('A2',4,1),('A2',5,2),('A3',1,1),('A3',2,2),('A3',3,-1),('A3',4,-1),('A3',5,-1)", "target, sp, grp")

#: At A2 families are numbered backwards, and each ancestor lacks some, so that pairs turn and chains of ancestors break.
E3 = f"""{GENES},
k AS (SELECT anc, child, sp, chrom, pos, chrom * 100 + pos AS m, strand, CASE WHEN anc = 'A2' THEN 199 - fam ELSE fam END AS fam
  FROM g JOIN {LINEAGE} USING (sp)
  WHERE (anc NOT IN ('A1', 'A0') OR sp NOT IN (1, 2) OR fam % 17 <> 1) AND (anc NOT IN ('A1', 'A0') OR sp > 3 OR fam % 19 <> 2)),
q AS (SELECT anc, child, sp, fam f1, strand s1, m n1, lead(fam) OVER w f2, lead(strand) OVER w s2, lead(m) OVER w n2 FROM k WINDOW w AS (PARTITION BY anc, child, sp, chrom ORDER BY pos)),
o AS (SELECT anc, child, sp, CASE WHEN f1<f2 THEN f1 ELSE f2 END a, CASE WHEN f1<f2 THEN s1 ELSE -s2 END sa, CASE WHEN f1<f2 THEN f2 ELSE f1 END b, CASE WHEN f1<f2 THEN s2 ELSE -s1 END sb,
  CASE WHEN f1<f2 THEN n1 ELSE n2 END m1, CASE WHEN f1<f2 THEN s1 ELSE -s2 END ms1, CASE WHEN f1<f2 THEN n2 ELSE n1 END m2, CASE WHEN f1<f2 THEN s2 ELSE -s1 END ms2 FROM q WHERE f1 <> f2),
cons AS (SELECT anc, a, sa, b, sb FROM o GROUP BY ALL HAVING count(DISTINCT child) >= 2),
kept AS (SELECT o.* FROM o JOIN cons USING (anc, a, sa, b, sb)),
both_ AS (SELECT anc, child, sp, a, sa, b, sb, 0 back, m1, ms1, m2, ms2 FROM kept UNION ALL SELECT anc, child, sp, a, sa, b, sb, 1, m2, -ms2, m1, -ms1 FROM kept),
rea AS (SELECT x.*, t.anc AS target, t.a ta, t.sa tsa, t.b tb, t.sb tsb FROM both_ x JOIN (SELECT DISTINCT anc, a, sa, b, sb, m1, ms1, m2, ms2 FROM o) t USING (m1, ms1, m2, ms2) JOIN {BELOW} ON v.anc = x.anc AND v.target = t.anc),
ev AS (SELECT target, ta, tsa, tb, tsb, sp, m1, ms1, m2, ms2 FROM rea UNION
  SELECT r.target, r.ta, r.tsa, r.tb, r.tsb, x.sp, x.m1, x.ms1, x.m2, x.ms2 FROM rea r JOIN both_ x ON x.anc = r.anc AND x.a = r.a AND x.sa = r.sa AND x.b = r.b AND x.sb = r.sb AND x.back = r.back AND x.child <> r.child),
cnt AS (SELECT target, ta, tsa, tb, tsb, grp, count(*) n FROM ev JOIN {GROUPS} USING (target, sp) GROUP BY ALL)
SELECT target AS anc, ta AS a, CAST(tsa AS BIGINT) AS sa, tb AS b, CAST(tsb AS BIGINT) AS sb, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS weight FROM cnt GROUP BY target, ta, tsa, tb, tsb"""


def _evidence_tables(spark, sf):
    tree = SpeciesTree.read(TREE)
    g = genes(spark, sf).select(F.concat(F.lit("M"), "sp").alias("species"), "chrom", F.col("pos").alias("idx"), (F.col("chrom") * 100 + F.col("pos")).alias("name"), "strand", "sp", "fam")
    lineages = spark.createDataFrame([(s, a, up[k - 1], k) for s in tree.species for up in [tree.up(s)] for k, a in enumerate(up) if k], "species string, anc string, child string, rank int")
    fam = F.when(F.col("anc") == "A2", 199 - F.col("fam")).otherwise(F.col("fam")).alias("fam_idx")
    names = g.select("name", "sp", "fam").crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in tree.ancestors], "anc string")))  # four rows
    high = F.col("anc") == "A1"  # lacking at A1 is lacking above it
    lack = (high & F.col("sp").isin(1, 2) & (F.col("fam") % 17 == 1)) | (high & (F.col("sp") <= 3) & (F.col("fam") % 19 == 2))
    return tree, g.drop("sp", "fam"), names.where(~lack).select("anc", fam, F.col("name").alias("member")), lineages


@query("WITH " + E3)
def propagated_evidence(spark, sf):
    tree, g, fams, lineages = _evidence_tables(spark, sf)
    obs = checkpointed(evidence.observations(g, fams, F.broadcast(lineages)))
    out = evidence.propagated_weights(obs, tree.closure(spark), tree.groups(spark))
    return out.select("anc", "a", F.col("sa").cast("bigint").alias("sa"), "b", F.col("sb").cast("bigint").alias("sb"), "weight")


# Trees


def _per_species(spark, sf) -> DataFrame:
    """species, n: its genes."""
    return genes(spark, sf).groupBy(F.concat(F.lit("M"), "sp").alias("species")).agg(F.count("*").alias("n"))


def _targets(spark, sf, found: dict[str, set[str]]) -> DataFrame:
    """target, found, n: the genes of its species, or of those below its ancestors."""
    t = SpeciesTree.read(TREE)
    rows = [(x, ",".join(sorted(f)), s) for x, f in found.items() for s in t.species if s in f or f & set(t.up(s))]
    wanted = spark.createDataFrame(rows, "target string, found string, species string")
    return _per_species(spark, sf).join(F.broadcast(wanted), "species").groupBy("target", "found").agg(F.sum("n").alias("n"))


def targets_sql(rows: str) -> str:
    return f"WITH {GENES}, s AS (SELECT 'M' || sp AS species, count(*) AS n FROM g GROUP BY 1) SELECT target, found, CAST(sum(n) AS BIGINT) AS n FROM {values(rows, 'target, found, of')} JOIN s ON contains(of, species) GROUP BY target, found"


@query(targets_sql("('A1','A1,A3','M1M2M3'),('=A1','A1','M1M2M3'),('\\A3','A0,A1,A3','M1M2M3M4M5'),('/A1','A0,A2','M1M2M3M4M5'),('A0,_=A0','A1,A2,A3','M1M2M3M4M5')"))
def targets_ancestor(spark, sf):
    t = SpeciesTree.read(TREE)
    return _targets(spark, sf, {x: set(t.ancestor_targets(x)) for x in ("A1", "=A1", "\\A3", "/A1", "A0,_=A0")})


@query(targets_sql("('A1','M1,M2,M3','M1M2M3'),('/A1','M4,M5','M4M5'),('A0,_A2','M1,M2,M3','M1M2M3'),('=M1,/A3','M1,M3,M4,M5','M1M3M4M5'),('A0,_=M2,_/A1','M1,M3','M1M3')"))
def targets_species(spark, sf):
    t = SpeciesTree.read(TREE)
    return _targets(spark, sf, {x: set(t.species_targets(x)) for x in ("A1", "/A1", "A0,_A2", "=M1,/A3", "A0,_=M2,_/A1")})


@query(f"WITH {GENES}, h AS (SELECT DISTINCT sp, pkey FROM g), v AS (SELECT * FROM "
       + values("('M1','M2','A3'),('M1','M3','A3,A1'),('M2','M3','A3,A1'),('M1','M4','A3,A1,A0,A2'),('M1','M5','A3,A1,A0,A2'),('M2','M4','A3,A1,A0,A2'),('M2','M5','A3,A1,A0,A2'),('M3','M4','A1,A0,A2'),('M3','M5','A1,A0,A2'),('M4','M5','A2')", "a, b, inner_path")
       + ") SELECT v.a, v.b, inner_path, count(*) AS shared FROM v JOIN h x ON v.a = 'M' || x.sp JOIN h y ON v.b = 'M' || y.sp AND y.pkey = x.pkey GROUP BY ALL")
def species_pair_paths(spark, sf):
    """Of every two species the ancestors between them, and the families that both have."""
    t = SpeciesTree.read(TREE)
    paths = spark.createDataFrame([(a, b, ",".join(t.path(a, b)[1:-1])) for a in t.species for b in t.species if a < b], "a string, b string, inner_path string")
    has = genes(spark, sf).groupBy("pkey").agg(F.collect_set(F.concat(F.lit("M"), "sp")).alias("of"))  # five names at most
    both = has.select(F.explode("of").alias("a"), "of").select("a", F.explode("of").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return both.join(F.broadcast(paths), ["a", "b"])


HIERARCHY = """e AS (SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
c AS (SELECT node anc, node AS dsc, 0 AS depth FROM e UNION ALL SELECT e.parent, c.dsc, c.depth + 1 FROM c JOIN e ON e.node = c.anc WHERE e.parent IS NOT NULL)"""


@query(f"WITH RECURSIVE {HIERARCHY} SELECT anc, count(*) AS n FROM c JOIN orders ON dsc = 'c' || o_custkey GROUP BY anc")
def subtree_totals(spark, sf):
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = r.select(tag("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")).union(n.select(tag("n", "n_nationkey"), tag("r", "n_regionkey"))).union(c.select(tag("c", "c_custkey"), tag("n", "c_nationkey")))
    counts = table(spark, sf, "orders").groupBy(tag("c", "o_custkey").alias("desc")).agg(F.count("*").alias("n"))
    return closure_of(edges).join(counts, "desc").groupBy("anc").agg(F.sum("n").alias("n"))


WORLD = HIERARCHY.replace("CAST(NULL AS VARCHAR) AS parent FROM region", "'w' AS parent FROM region UNION ALL SELECT 'w', NULL")


def _world(spark, sf) -> DataFrame:
    """Regions, nations and customers as one tree."""
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    top = spark.createDataFrame([("w", None)], "node string, parent string")
    return top.union(r.select(tag("r", "r_regionkey"), F.lit("w"))).union(n.select(tag("n", "n_nationkey"), tag("r", "n_regionkey"))).union(c.select(tag("c", "c_custkey"), tag("n", "c_nationkey")))


@query(f"WITH RECURSIVE {WORLD} SELECT anc, dsc, depth FROM c")
def tree_closure(spark, sf):
    return closure_of(_world(spark, sf)).withColumnRenamed("desc", "dsc")


TRADE = "SELECT DISTINCT c_nationkey AS x, s_nationkey AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey"


@query(f"WITH RECURSIVE {WORLD}, t AS ({TRADE}) SELECT 'n' || t.x AS a, 'n' || t.y AS b, arg_min(x.anc, x.depth) AS lca, CAST(min(x.depth + y.depth) AS BIGINT) AS steps FROM t JOIN c x ON x.dsc = 'n' || t.x JOIN c y ON y.dsc = 'n' || t.y AND y.anc = x.anc GROUP BY 1, 2")
def tree_lca(spark, sf):
    """Of the nations of a line's customer and supplier: what they have in common, and the steps between them."""
    lines, o, c, s_ = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    met = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s_, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = met.select(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b")).distinct()
    up = closure_of(_world(spark, sf).where("node not like 'c%'"))  # regions and nations
    side = lambda end: up.select("anc", F.col("desc").alias(end), F.col("depth").alias(f"d{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "anc"])
    return both.groupBy("a", "b").agg(F.min_by("anc", "da").alias("lca"), F.min(F.col("da") + F.col("db")).cast("bigint").alias("steps"))


@query(f"""WITH RECURSIVE {WORLD}, q AS (SELECT o_orderkey, 'c' || o_custkey AS a, 'c' || o_orderkey % 997 AS b FROM orders UNION ALL SELECT o_orderkey, 'n' || o_orderkey % 25, 'c' || o_custkey FROM orders)
SELECT o_orderkey, a, b, arg_min(x.anc, x.depth) AS lca, CAST(min(x.depth + y.depth) AS BIGINT) AS steps, min(x.depth) = 0 AS above FROM q JOIN c x ON x.dsc = a JOIN c y ON y.dsc = b AND y.anc = x.anc GROUP BY o_orderkey, a, b""")
def common_ancestors(spark, sf):
    """Of each order's customer and another, and of a nation and the customer: the common node, the steps between, and whether the one is above."""
    from synteny_spark.operators import tours

    o = table(spark, sf, "orders")
    tag = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    key, own = F.col("o_orderkey"), tag("c", F.col("o_custkey"))
    pairs = o.select(key, own.alias("a"), tag("c", key % 997).alias("b")).union(o.select(key, tag("n", key % 25), own)).distinct()
    return tours.common_ancestors(tours.toured(_world(spark, sf)), pairs).withColumn("steps", F.col("steps").cast("bigint"))


@query(f"""WITH RECURSIVE {WORLD}, u AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 = 1), k AS (SELECT dsc FROM c GROUP BY dsc HAVING NOT bool_or(anc IN (SELECT node FROM u))),
v AS (SELECT 'c' || o_custkey AS node, count(*) AS n FROM orders GROUP BY 1) SELECT c.anc AS node, CAST(coalesce(sum(v.n), 0) AS BIGINT) AS total, count(*) AS n FROM c JOIN k ON k.dsc = c.dsc LEFT JOIN v ON v.node = c.dsc GROUP BY c.anc""")
def pruned_totals(spark, sf):
    """Orders below each node, customers in debt and every sixth nation left out with all below them."""
    from synteny_spark.operators import tours

    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string")).alias("node")
    counts = table(spark, sf, "orders").groupBy(tag("c", "o_custkey")).agg(F.count("*").alias("value"))
    cut = table(spark, sf, "customer").where("c_acctbal < 0").select(tag("c", "c_custkey")).union(table(spark, sf, "nation").where("n_nationkey % 6 = 1").select(tag("n", "n_nationkey")))
    return tours.pruned_totals(tours.toured(_world(spark, sf)), counts, cut)


# Statistics


@query(f"WITH {BLOCKS}, t AS (SELECT nation, n, sum(n) OVER (PARTITION BY nation ORDER BY n DESC ROWS UNBOUNDED PRECEDING) up, sum(n) OVER (PARTITION BY nation) al FROM bl) SELECT nation, max(n) AS n50 FROM t WHERE up >= al * 50 / 100.0 GROUP BY nation")
def nx_by_group(spark, sf):
    return stats.nx(blocks(spark, sf), ["nation"], "n", 50, "n50")


@query(f"""WITH {BLOCKS}, t AS (SELECT nation, list_sort(list(n)) v, count(*) k, sum(n * n) / sum(n) wa, avg(n) mean, stddev_pop(n) sd FROM bl GROUP BY nation),
u AS (SELECT nation, n, sum(n) OVER (PARTITION BY nation ORDER BY n DESC ROWS UNBOUNDED PRECEDING) up, sum(n) OVER (PARTITION BY nation) al FROM bl),
x AS (SELECT nation, min(n) AS least, max(n) AS most, max(n) FILTER (up >= al * 75 / 100.0) n75, max(n) FILTER (up >= al * 50 / 100.0) n50, max(n) FILTER (up >= al * 25 / 100.0) n25 FROM u GROUP BY nation)
SELECT nation, least, v[1 + CAST(floor(25 * (k - 1) / 100) AS INTEGER)] q25, v[1 + CAST(floor(50 * (k - 1) / 100) AS INTEGER)] q50, v[1 + CAST(floor(75 * (k - 1) / 100) AS INTEGER)] q75, n75, n50, n25, round(wa, 6) wa, most, round(mean, 6) mean, round(sd, 6) sd, k AS n FROM t JOIN x USING (nation)""")
def quantile_summary(spark, sf):
    s = stats.summary(blocks(spark, sf), ["nation"], "n")
    return s.select("nation", F.col("min").alias("least"), "q25", "q50", "q75", "n75", "n50", "n25", F.round("wa", 6).alias("wa"), F.col("max").alias("most"), *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "n")


@query("SELECT CAST(l_quantity AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def value_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "lineitem").select(F.col("l_quantity").cast("bigint").alias("v")), "v")


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS wm FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(stats.weighted_mean("l_discount", "l_quantity"), 6).alias("wm"))


@query("SELECT l_linenumber, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def correlation(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


BEST = """c AS (SELECT l_orderkey % 4 AS anc, 1 AS ord, l_orderkey AS block, count(*) n FROM lineitem GROUP BY 1, 2, 3 UNION ALL SELECT l_orderkey % 4, 2, l_orderkey * 10 + l_linenumber % 2, count(*) FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT anc, ord, n, sum(n) OVER (PARTITION BY anc, ord ORDER BY n DESC ROWS UNBOUNDED PRECEDING) up, sum(n) OVER (PARTITION BY anc, ord) al FROM c),
x AS (SELECT anc, ord, max(n) n50 FROM t WHERE up >= al * 50 / 100.0 GROUP BY 1, 2)"""


@query(f"WITH {BEST} SELECT anc, 'c' || ord AS candidate, n50 FROM x QUALIFY row_number() OVER (PARTITION BY anc ORDER BY n50 DESC, ord) = 1")
def best_reconstruction(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("anc", F.col("l_orderkey") % 4)
    one = lines.groupBy("anc", F.col("l_orderkey").alias("block")).agg(F.count("*").alias("n")).withColumns({"candidate_ord": F.lit(1), "candidate": F.lit("c1")})
    two = lines.groupBy("anc", (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("block")).agg(F.count("*").alias("n")).withColumns({"candidate_ord": F.lit(2), "candidate": F.lit("c2")})
    return stats.best_reconstruction(one.unionByName(two))


ORTHOS12 = GENES + ", x AS (SELECT chrom % 6 AS c1, pkey FROM g WHERE sp = 1), y AS (SELECT chrom % 7 AS c2, pkey FROM g WHERE sp = 2), oo AS (SELECT c1, c2 FROM x JOIN y USING (pkey))"


def _chrom_pairs(spark, sf):
    g = genes(spark, sf)
    return g.where("sp = 1").select((F.col("chrom") % 6).alias("c1"), "pkey").join(g.where("sp = 2").select((F.col("chrom") % 7).alias("c2"), "pkey"), "pkey").select("c1", "c2")


@query(f"WITH {ORTHOS12} SELECT c1, " + ", ".join(f"count(*) FILTER (c2 = {k}) AS n{k}" for k in range(7)) + " FROM oo GROUP BY c1")
def ortholog_count_matrix(spark, sf):
    return stats.count_matrix(_chrom_pairs(spark, sf), "c1", "c2", range(7))


@query(f"WITH {ORTHOS12}, n AS (SELECT c1, c2, count(*) cnt FROM oo GROUP BY 1, 2), t AS (SELECT *, sum(cnt) OVER (PARTITION BY c1 ORDER BY cnt DESC, c2 DESC ROWS UNBOUNDED PRECEDING) cum, sum(cnt) OVER (PARTITION BY c1) al FROM n) SELECT c1, c2, cnt FROM t WHERE cum - cnt < al * 90 / 100.0")
def dominant_homolog(spark, sf):
    return stats.dominant(_chrom_pairs(spark, sf), "c1", "c2", 90)


@query("""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, substr(t, 11, 40) AS p FROM s), d AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(p), 2)), lambda i: substr(p, i, 2))) AS x FROM w)
SELECT w.doc_id AS doc_id, len(p) - len(regexp_extract_all(p, 'N')) AS n1, len(regexp_extract_all(p, '[gc]')) AS gc1, count(x) FILTER (len(x) = 2 AND NOT contains(x, 'N')) AS n2, count(x) FILTER (x = 'th') AS gc2 FROM w LEFT JOIN d USING (doc_id) GROUP BY w.doc_id, p""")
def window_content(spark, sf):
    """Letters and pairs of letters in places 10 to 49 of a text, N excluded."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n1, gc1 = stats.window_content("t", F.lit(10), F.lit(49), ["g", "c"])
    n2, gc2 = stats.window_content("t", F.lit(10), F.lit(49), ["th"])
    return docs.select("doc_id", n1.alias("n1"), gc1.alias("gc1"), n2.alias("n2"), gc2.alias("gc2"))


@query(f"WITH {GENES}, f AS (SELECT DISTINCT fam, pkey FROM g) SELECT 'A' AS anc, f.fam AS fam_idx, 'M' || sp AS species, array_to_string(list(DISTINCT 'p' || f.pkey ORDER BY 'p' || f.pkey), ' ') AS members FROM f JOIN g ON g.pkey = f.pkey GROUP BY f.fam, sp")
def family_composition(spark, sf):
    """Each family's genes by species."""
    _, _, fams = _sides(spark, sf)
    g = genes(spark, sf).select(F.concat(F.lit("M"), "sp").alias("species"), F.concat(F.lit("p"), F.col("pkey")).alias("name"))
    return stats.family_composition(fams, g).select("anc", F.col("fam_idx").cast("bigint").alias("fam_idx"), "species", F.array_join("members", " ").alias("members"))


@query("""WITH e AS (SELECT user_id AS chrom, count(*) AS n, max(epoch_us(ts)) + 100 AS top, min(epoch_us(ts)) AS low FROM events GROUP BY 1) SELECT chrom, n, CAST(top - low AS BIGINT) AS extent, CAST(100 * n AS BIGINT) AS covered, CASE WHEN n > 1 THEN (top - low - 100 * n) / (n - 1) END AS mean_gap FROM e""")
def gene_density(spark, sf):
    e = pr.interval_events(spark, sf).select(F.lit("g").alias("genome"), F.col("user_id").alias("chrom"), "beg", (F.col("beg") + 100).alias("end"))
    return stats.gene_density(e).drop("genome")


@query(f"WITH {NAMES_CTE} SELECT name FROM n WHERE kind IN ('Chromosome', 'Scaffold')")
def placed_contigs(spark, sf):
    return filters.placed_contigs(contig_class(spark, sf), "name").select("name")


@query("SELECT lang, letters, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[acgt]')) AS letters FROM documents) GROUP BY 1, 2")
def composition(spark, sf):
    return stats.composition(table(spark, sf, "documents"), ["lang"], "text", "acgt")


@query("SELECT lang, x || y AS letters, CAST(sum(len(regexp_extract_all(replace(lower(text), x || y, chr(1) || x || y), chr(1)))) AS BIGINT) AS n FROM documents, (VALUES ('a'),('c'),('g'),('t')) p(x), (VALUES ('a'),('c'),('g'),('t')) q(y) WHERE x <> y GROUP BY 1, 2 HAVING n > 0")
def pair_composition(spark, sf):
    """Pairs of unlike letters, which can't overlap themselves."""
    return stats.composition(table(spark, sf, "documents"), ["lang"], "text", "acgt", 2).where(F.substring("letters", 1, 1) != F.substring("letters", 2, 1))


@query("""WITH s AS (SELECT l_suppkey % 50 AS s, l_linenumber % 2 AS side, l_partkey % 200 AS f FROM lineitem GROUP BY ALL), a AS (SELECT s, f FROM s WHERE side = 0), b AS (SELECT s, f FROM s WHERE side = 1),
i AS (SELECT s, count(*) k FROM a JOIN b USING (s, f) GROUP BY s), u AS (SELECT s, count(DISTINCT f) k FROM s GROUP BY s) SELECT u.s AS s, round(coalesce(i.k, 0) / u.k, 6) AS score FROM u LEFT JOIN i ON i.s = u.s""")
def jaccard_children(spark, sf):
    lines = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("s"), (F.col("l_linenumber") % 2).alias("side"), (F.col("l_partkey") % 200).alias("f"))
    sets = lines.groupBy("s").agg(F.collect_set(F.when(F.col("side") == 0, F.col("f"))).alias("x"), F.collect_set(F.when(F.col("side") == 1, F.col("f"))).alias("y"))
    return sets.select("s", F.round(stats.jaccard("x", "y"), 6).alias("score"))


@query(f"WITH {GENES} SELECT fam, count(DISTINCT sp) AS species, count(*) AS genes, count(DISTINCT sp) >= 0.9 * 5 AND count(*) <= 1.1 * count(DISTINCT sp) * 60 AS kept FROM g GROUP BY fam")
def size_filter_measures(spark, sf):
    g = genes(spark, sf).groupBy("fam").agg(F.countDistinct("sp").alias("species"), F.count("*").alias("genes"))
    return g.withColumn("kept", (F.col("species") >= 0.9 * 5) & (F.col("genes") <= F.lit(1.1) * F.col("species") * 60))


# Order


RUNS = GENES + """, x AS (SELECT fam, min(chrom * 100 + pos) p, arg_min(strand, chrom * 100 + pos) s FROM g WHERE sp = 1 GROUP BY fam), y AS (SELECT fam, min(chrom * 100 + pos) p, arg_min(strand, chrom * 100 + pos) s FROM g WHERE sp = 2 GROUP BY fam),
z AS (SELECT row_number() OVER (ORDER BY x.p) i1, x.s s1, row_number() OVER (ORDER BY y.p) i2, y.s s2 FROM x JOIN y USING (fam)),
t AS (SELECT *, CASE WHEN i2 = lag(i2) OVER w + lag(s1) OVER w * lag(s2) OVER w AND lag(s1) OVER w * s1 = lag(s2) OVER w * s2 THEN 0 ELSE 1 END nw FROM z WINDOW w AS (ORDER BY i1)),
k AS (SELECT *, sum(nw) OVER (ORDER BY i1 ROWS UNBOUNDED PRECEDING) run FROM t)"""


#: A genome of the lines of all orders, on four hundred chromosomes, and one that had it twice: each copy has lost some lines, and every fourth order
#: of the first copy and every fifth of the second is turned.
TWICE = """ln AS (SELECT l_orderkey AS o, l_partkey AS fam, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS p, l_suppkey % 10 AS lost FROM lineitem),
g1 AS (SELECT CAST(o % 400 AS VARCHAR) AS chrom, row_number() OVER (PARTITION BY o % 400 ORDER BY o, p) - 1 AS idx, fam, s FROM ln),
cp AS (SELECT c || o % 7 AS chrom, o, CASE WHEN o % m = 0 THEN -p ELSE p END AS p, fam, CASE WHEN o % m = 0 THEN -s ELSE s END AS s FROM ln, (VALUES ('a', 4, 3), ('b', 5, 7)) t(c, m, x) WHERE lost <> x),
g2 AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY o, p) - 1 AS idx, fam, s FROM cp)"""

#: The walk along each chromosome, gene by gene: what is open, and where its run began.
WALK = TWICE + """, n1 AS MATERIALIZED (SELECT x.chrom, y.idx AS i, x.fam f1, x.s s1, y.fam f2, y.s s2 FROM g1 x JOIN g1 y ON y.chrom = x.chrom AND y.idx = x.idx + 1),
lk AS MATERIALIZED (SELECT n.chrom, n.i, {'c': p.chrom, 'k': p.idx, 'u': p.s} AS p, {'c': q.chrom, 'k': q.idx, 'u': q.s} AS q FROM n1 n JOIN g2 p ON p.fam = n.f1 JOIN g2 q ON q.chrom = p.chrom AND q.fam = n.f2 AND q.idx - p.idx = n.s1 * p.s AND n.s1 * n.s2 = p.s * q.s),
fl AS MATERIALIZED (SELECT chrom, i, min({'q': q, 'p': p}) AS m FROM lk GROUP BY 1, 2), pl AS MATERIALIZED (SELECT chrom, i, p, min(q) AS q FROM lk GROUP BY 1, 2, 3),
wk AS (SELECT DISTINCT chrom, CAST(0 AS BIGINT) AS i, CAST(NULL AS STRUCT(c VARCHAR, k BIGINT, u INTEGER)) AS op, CAST(0 AS BIGINT) AS run, CAST(NULL AS STRUCT(c VARCHAR, k BIGINT, u INTEGER)) AS was FROM g1
  UNION ALL SELECT w.chrom, w.i + 1, CASE WHEN w.op IS NULL THEN fl.m.q ELSE pl.q END, CASE WHEN w.op IS NULL AND fl.m IS NULL OR w.op IS NOT NULL AND pl.q IS NULL THEN w.i + 1 ELSE w.run END, CASE WHEN w.op IS NULL THEN fl.m.p END
  FROM wk w JOIN (SELECT chrom, count(*) AS n FROM g1 GROUP BY 1) z ON z.chrom = w.chrom AND w.i + 1 < z.n LEFT JOIN fl ON fl.chrom = w.chrom AND fl.i = w.i + 1 LEFT JOIN pl ON pl.chrom = w.chrom AND pl.i = w.i + 1 AND pl.p = w.op),
tk AS (SELECT chrom, i AS idx, run, op AS pl FROM wk WHERE op IS NOT NULL UNION ALL SELECT chrom, i - 1, run, was FROM wk WHERE was IS NOT NULL),
dg AS (SELECT chrom, idx, run, pl FROM tk UNION ALL SELECT g1.chrom, g1.idx, g1.idx, f.pl FROM g1 JOIN (SELECT fam, min({'c': chrom, 'k': idx, 'u': s}) AS pl FROM g2 GROUP BY fam) f USING (fam) WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.chrom = g1.chrom AND tk.idx = g1.idx))"""

#: Genes of a chunk so small that runs cross many seams on the smallest tables.
FEW_GENES = 16


def _twice(spark, sf) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    ln = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("fam"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"), F.row_number().over(order).alias("p"), (F.col("l_suppkey") % 10).alias("lost"))
    dense = lambda df: df.withColumn("idx", F.row_number().over(W.partitionBy("chrom").orderBy("o", "p")) - 1).select("chrom", "idx", "fam", "strand")
    copies = [ln.where(f"lost <> {x}").withColumns({"chrom": F.concat(F.lit(c), F.col("o") % 7), "p": F.when(F.col("o") % m == 0, -F.col("p")).otherwise(F.col("p")), "strand": F.when(F.col("o") % m == 0, -F.col("strand")).otherwise(F.col("strand"))}) for c, m, x in (("a", 4, 3), ("b", 5, 7))]
    return dense(ln.withColumn("chrom", (F.col("o") % 400).cast("string"))), dense(copies[0].unionByName(copies[1]))


@query(f"WITH RECURSIVE {WALK} SELECT chrom, idx, run, pl.c AS c2, pl.k AS k2, CAST(pl.u AS BIGINT) AS s2 FROM dg")
def diagonal_runs(spark, sf):
    """Genes of the first genome in maximal collinear runs of their many orthologs, by chunks."""
    from synteny_spark.operators.synteny import placed

    return placed(*_twice(spark, sf), chunk=FEW_GENES).select("chrom", "idx", "run", "c2", "k2", F.col("s2").cast("bigint").alias("s2"))


GAP = 2

#: Runs of one pair of chromosomes and direction as a list, of which one is given away in each step: to the run that is growing, or else
#: as the head of the next.
MERGE = WALK + f""", rn AS (SELECT chrom, run, pl.c AS c2, CASE WHEN arg_min(s * pl.u, idx) > 0 THEN 1 ELSE -1 END AS way, min(idx) AS lo1, max(idx) AS hi1, min(pl.k) AS lo2, max(pl.k) AS hi2 FROM dg JOIN g1 USING (chrom, idx) GROUP BY chrom, run, pl.c),
ar AS MATERIALIZED (SELECT chrom, c2, way, count(*) AS n, list({{'run': run, 'lo1': lo1, 'hi1': hi1, 'lo2': lo2, 'hi2': hi2}} ORDER BY lo1) AS r FROM rn GROUP BY ALL),
ms AS (SELECT chrom, c2, way, n, r, [CAST(1 AS BIGINT)] AS done, CAST(1 AS BIGINT) AS head, CAST(1 AS BIGINT) AS j, 0 AS part, r[1].hi1 AS hi1, r[1].lo2 AS lo2, r[1].hi2 AS hi2 FROM ar
  UNION ALL SELECT chrom, c2, way, n, r, list_append(done, to_), CASE WHEN grows THEN head ELSE to_ END, to_, CASE WHEN grows THEN part + 1 ELSE 0 END,
    CASE WHEN grows THEN greatest(hi1, r[to_].hi1) ELSE r[to_].hi1 END, CASE WHEN grows THEN least(lo2, r[to_].lo2) ELSE r[to_].lo2 END, CASE WHEN grows THEN greatest(hi2, r[to_].hi2) ELSE r[to_].hi2 END
  FROM (SELECT *, coalesce(next_, other) AS to_, next_ IS NOT NULL AS grows FROM (SELECT *, list_filter(range(j + 1, n + 1), lambda k: NOT list_contains(done, k) AND r[k].lo1 <= hi1 + {GAP + 1}
      AND CASE WHEN way > 0 THEN r[k].lo2 > hi2 AND r[k].lo2 <= hi2 + {GAP + 1} ELSE r[k].hi2 < lo2 AND r[k].hi2 >= lo2 - {GAP + 1} END)[1] AS next_, list_filter(range(1, n + 1), lambda k: NOT list_contains(done, k))[1] AS other FROM ms)) WHERE to_ IS NOT NULL)"""


@query(f"WITH RECURSIVE {MERGE} SELECT chrom, r[j].run AS run, r[head].run AS head, CAST(part AS BIGINT) AS part FROM ms")
def merged_runs(spark, sf):
    """Those runs joined across gaps of at most two genes."""
    from synteny_spark.operators.synteny import merged, placed

    return merged(placed(*_twice(spark, sf), chunk=FEW_GENES), GAP).select("chrom", "run", "head", F.col("part").cast("bigint").alias("part"))


@query(f"WITH {RUNS} SELECT CAST(run AS BIGINT) AS run, count(*) AS len, min(i1) AS first1, min(i2) AS low2 FROM k GROUP BY run")
def collinear_runs(spark, sf):
    g = genes(spark, sf).withColumn("p", F.col("chrom") * 100 + F.col("pos"))
    first = lambda sp, p, s: g.where(F.col("sp") == sp).groupBy("fam").agg(F.min("p").alias(p), F.min_by("strand", "p").alias(s))
    both = first(1, "p1", "s1").join(first(2, "p2", "s2"), "fam")  # at most a row for each of 200 families
    points = both.select(F.lit(1).alias("c1"), F.lit(1).alias("c2"), "s1", "s2", F.row_number().over(W.orderBy("p1")).alias("i1"), F.row_number().over(W.orderBy("p2")).alias("i2"))
    return windows.collinear_runs(points, ["c1"]).groupBy("run").agg(F.count("*").alias("len"), F.min("i1").cast("bigint").alias("first1"), F.min("i2").cast("bigint").alias("low2"))


DEDUPE = "d AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)"


@query(f"WITH {DEDUPE} SELECT user_id, event_id, event_type FROM d WHERE was IS NULL OR was <> event_type")
def run_dedupe(spark, sf):
    return windows.dedupe_runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query(f"""WITH {GENES}, e AS (SELECT chrom, arg_min(fam, pos) f0, arg_min(strand, pos) s0, arg_max(fam, pos) f1, arg_max(strand, pos) s1 FROM g GROUP BY chrom)
SELECT chrom, 'left' AS side, f0 AS id, s0 AS s, 1 AS direction FROM e UNION ALL SELECT chrom, 'right', f1, s1, 1 FROM e UNION ALL SELECT chrom, 'left', f1, -s1, -1 FROM e UNION ALL SELECT chrom, 'right', f0, -s0, -1 FROM e""")
def block_extremities(spark, sf):
    return windows.extremities(genes(spark, sf), "chrom", ["pos"], "fam", "strand")


@query("WITH t AS (SELECT o_custkey, o_totalprice >= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) ok FROM orders) SELECT o_custkey, coalesce(bool_and(ok), true) AS sorted FROM t GROUP BY 1")
def sorted_check(spark, sf):
    return windows.is_sorted(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("WITH t AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END nw FROM events), k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM t) SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS place FROM k")
def run_offsets(spark, sf):
    return windows.run_offset(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", "place").select("event_id", F.col("place").cast("bigint").alias("place"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS key FROM part")
def natural_sort(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fc.natural_key(F.col("p_name")).alias("key"))


# Blocks


@query(f"WITH {BLOCKS} SELECT nation, block, CASE WHEN n >= 10 THEN n ELSE 0 END AS n FROM bl")
def block_filter_fixed(spark, sf):
    return filters.filter_blocks_fixed(blocks(spark, sf), 10).select("nation", "block", "n")


@query(f"WITH {BLOCKS}, t AS (SELECT nation, n, sum(n) OVER (PARTITION BY nation ORDER BY n DESC ROWS UNBOUNDED PRECEDING) up, sum(n) OVER (PARTITION BY nation) al FROM bl), k AS (SELECT nation, max(n) cut FROM t WHERE up >= al * 50 / 100.0 GROUP BY nation) SELECT nation, block, CASE WHEN n >= cut THEN n ELSE 0 END AS n FROM bl JOIN k USING (nation)")
def block_filter_prop(spark, sf):
    return filters.filter_blocks_proportional(blocks(spark, sf), 50, ["nation"]).select("nation", "block", "n")


def _gene_blocks(spark, sf) -> DataFrame:
    """anc, block_id, n, ids, strands, support: a customer's orders in the order of their keys."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("block_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("anc"), F.col("c_custkey").alias("block_id"))
    b = o.join(c, "block_id")
    strand = F.transform("ids", lambda k: F.when(k % 2 == 0, 1).otherwise(-1))
    return b.select("anc", "block_id", F.size("ids").alias("n"), "ids", strand.alias("strands"), F.transform(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))), lambda k: (k % 9).cast("string")).alias("support"))


CUST = "x AS (SELECT c_nationkey AS nation, o_custkey AS cust, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS s, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE 1 END AS dir FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(f"""WITH {CUST}, y AS (SELECT *, lag(k) OVER (PARTITION BY nation, cust ORDER BY k * dir) AS was FROM x)
SELECT CAST(nation AS VARCHAR) AS anc, count(*) AS n, array_to_string(list(CAST(k AS VARCHAR) ORDER BY cust, k * dir), ' ') AS ids, array_to_string(list(CAST(s * dir AS VARCHAR) ORDER BY cust, k * dir), ' ') AS strands,
coalesce(array_to_string(list(CAST(CASE WHEN was IS NULL THEN 1 WHEN dir = 1 THEN was % 9 ELSE k % 9 END AS VARCHAR) ORDER BY cust, k * dir)[2:], ' '), '') AS support FROM y GROUP BY nation""")
def blocks_of_blocks_expand(spark, sf):
    inner = _gene_blocks(spark, sf)
    outer = inner.groupBy("anc").agg(F.sort_array(F.collect_list("block_id")).alias("ids")).select("anc", F.lit(1).alias("block_id"), "ids", F.transform("ids", lambda c: F.when(c % 3 == 0, -1).otherwise(1)).alias("strands"), F.transform("ids", lambda c: F.lit("1")).alias("support"))
    out = joins.expand_blocks(outer, inner)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return out.select("anc", F.col("n").cast("bigint").alias("n"), text("ids"), text("strands"), text("support"))


@query(f"WITH {CUST}, h AS (SELECT nation, cust, count(*) n FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w k, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY nation ORDER BY n DESC, cust ROWS UNBOUNDED PRECEDING) s FROM h WINDOW w AS (PARTITION BY nation ORDER BY n DESC, cust)) SELECT CAST(nation AS VARCHAR) AS anc, CASE WHEN r.n = 1 THEN 'singleton_' || CAST(r.s AS BIGINT) ELSE 'CAR_' || CAST(r.k - r.s AS BIGINT) END AS block, row_number() OVER (PARTITION BY cust ORDER BY x.k) - 1 AS beg, x.s AS strand, x.k AS gene FROM x JOIN r USING (nation, cust)")
def publish_blocks(spark, sf):
    out = joins.publish(_gene_blocks(spark, sf), by_size=True)
    return out.select("anc", "block", F.col("beg").cast("bigint").alias("beg"), "strand", F.col("fam_idx").alias("gene"))


def _filed(spark, lines: DataFrame, anc: str, compression: str = "none") -> str:
    """The folder of one ancestor, written as text."""
    path = scratch(spark, "files")
    sinks.text_files(lines, path, compression)
    return f"{path}/anc={anc}"


@query(f"WITH {WEIGHT} SELECT a, sa, b, sb, weight FROM r WHERE weight >= 2")
def adjacencies_filed(spark, sf):
    """Adjacencies written as text and read again, those of weight two and more."""
    adj = _adjacency(spark, sf).withColumn("anc", F.lit("A0"))
    return readers.read_adjacencies(spark, _filed(spark, sinks.adjacency_lines(adj), "A0"), "A0", 2).select(*[F.col(c).cast("bigint").alias(c) for c in ("a", "sa", "b", "sb")], "weight")


@query(planted.DENOVO)
def blocks_filed(spark, sf):
    """Blocks written as text in order, compressed, and read again: a block's number is its line."""
    from synteny_spark.operators.linear import denovo

    made = denovo(planted.adjacencies(spark, sf, True), planted.universe(spark, sf))
    return planted.flat(readers.read_blocks(spark, _filed(spark, sinks.block_lines(made), "A0", "gzip")))


@query(f"WITH {GENES} SELECT fam AS fam_idx, 'f' || fam AS name, array_to_string(list(DISTINCT 'p' || pkey ORDER BY 'p' || pkey), ' ') AS members FROM g GROUP BY fam")
def families_filed(spark, sf):
    """Families written as text and read again: a family's number is its line."""
    _, _, fams = _sides(spark, sf)
    read = readers.read_families(spark, _filed(spark, sinks.family_lines(fams), "A"), "A")
    return read.select(F.col("fam_idx").cast("bigint").alias("fam_idx"), "name", F.array_join(F.array_sort("members"), " ").alias("members"))


@query(f"WITH {GENES} SELECT CAST(chrom AS VARCHAR) AS chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx, pos AS beg, pos + 1 AS stop, CAST(strand AS BIGINT) AS strand, 'p' || pkey || ' x' || pkey AS names FROM g WHERE sp = 1")
def genes_filed(spark, sf):
    """A genome written as a gene list and read again."""
    g = genes(spark, sf).where("sp = 1").select(F.lit("M1").alias("genome"), F.col("chrom").cast("string").alias("chrom"), F.col("pos").alias("idx"), F.col("pos").alias("beg"), (F.col("pos") + 1).alias("end"), "strand", F.array(F.concat(F.lit("p"), F.col("pkey")), F.concat(F.lit("x"), F.col("pkey"))).alias("names"))
    read = readers.read_genes(spark, _filed(spark, sinks.gene_lines(g), "M1"), "M1")
    return read.select("chrom", *[F.col(c).cast("bigint").alias(n) for c, n in (("idx", "idx"), ("beg", "beg"), ("end", "stop"), ("strand", "strand"))], F.array_join("names", " ").alias("names"))


@query(f"WITH {GENES} SELECT fam + 1 AS line, array_to_string(list(DISTINCT 'p' || pkey ORDER BY 'p' || pkey), ' ') AS members FROM g GROUP BY fam")
def groups_filed(spark, sf):
    """Orthology groups, a line each."""
    _, _, fams = _sides(spark, sf)
    read = readers.read_groups(spark, _filed(spark, fams.select("anc", F.col("fam_idx").alias("ord"), F.array_join("members", " ").alias("value")), "A"), "A")
    return read.select(F.col("line").cast("bigint").alias("line"), F.array_join(F.array_sort("members"), " ").alias("members"))


@query("SELECT 'p' || p_partkey AS name, upper(repeat(regexp_replace(p_type || p_name, '[^A-Za-z]', '', 'g'), 1 + p_size)) AS sequence FROM part")
def sequences_filed(spark, sf):
    """Sequences written in lines of sixty letters and read again."""
    letters = F.regexp_replace(F.concat("p_type", "p_name"), "[^A-Za-z]", "")
    found = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), F.repeat(letters, 1 + F.col("p_size")).alias("sequence"))
    path = scratch(spark, "files")
    sinks.fasta_lines(found).write.mode("append").text(path)
    return files.fasta(spark, path)


BRAND = "Brand#13"


@query(f"SELECT unnest(['p' || p_partkey, 's' || p_size]) AS name FROM part WHERE p_brand = '{BRAND}'")
def other_names(spark, sf):
    """All other names of the genes that have one name."""
    named = table(spark, sf, "part").select(F.array(F.concat(F.lit("p"), F.col("p_partkey")), "p_brand", F.concat(F.lit("s"), F.col("p_size"))).alias("names"))
    return joins.other_names(named, BRAND)


@query(f"WITH {WEIGHT}, e AS (SELECT fam FROM g GROUP BY fam HAVING count(*) % 2 = 0) SELECT a, sa, b, sb, weight FROM r WHERE weight > 0 AND a IN (SELECT fam FROM e) AND b IN (SELECT fam FROM e)")
def edges_between(spark, sf):
    """Adjacencies of which both ends are in one set, here families of an even number of genes."""
    even = genes(spark, sf).groupBy(F.lit("A0").alias("anc"), F.col("fam").alias("id")).agg(F.count("*").alias("n")).where("n % 2 = 0")
    adj = _adjacency(spark, sf).select(F.lit("A0").alias("anc"), F.col("a").alias("g1"), "sa", F.col("b").alias("g2"), "sb", "weight")
    return filters.singleton_edges(adj, even).select(F.col("g1").alias("a"), "sa", F.col("g2").alias("b"), "sb", "weight")


@query(f"WITH {BLOCKS} SELECT CAST(nation AS VARCHAR) AS anc, block, n FROM bl WHERE nation IN (3, 7, 11)")
def copied_blocks(spark, sf):
    """The blocks of some ancestors."""
    return filters.copy_blocks(blocks(spark, sf).select(F.col("nation").cast("string").alias("anc"), "block", "n"), ["3", "7", "11"])


@query(f"WITH {WEIGHT} SELECT a, sa, b, sb, weight FROM r WHERE weight > 0 UNION SELECT b, -sb, a, -sa, weight FROM r WHERE weight > 0")
def mirror_union(spark, sf):
    return evidence.mirrored(_adjacency(spark, sf).withColumn("anc", F.lit("A0"))).drop("anc")


@query(f"WITH {PAIRS} SELECT DISTINCT a, sa, b, sb FROM c WHERE sp = 1 INTERSECT SELECT a, sa, b, sb FROM c WHERE sp = 2")
def pair_intersection(spark, sf):
    pairs = windows.canonical(windows.adjacent_pairs(genes(spark, sf), ["sp", "chrom"]), ["sp"])
    return pairs.where("sp = 1").drop("sp").intersect(pairs.where("sp = 2").drop("sp"))


@query(f"WITH {WEIGHT} SELECT DISTINCT pkey % 1000 AS id FROM g WHERE pkey % 1000 NOT IN (SELECT a FROM r WHERE weight > 1 UNION SELECT b FROM r WHERE weight > 1)")
def unused_genes(spark, sf):
    used = _adjacency(spark, sf).where("weight > 1")
    ids = used.select(F.col("a").alias("id")).union(used.select("b"))
    return genes(spark, sf).select((F.col("pkey") % 1000).alias("id")).distinct().join(ids, "id", "left_anti")


@query("SELECT p_partkey, unnest(['D', 'S', 'B', 'C']) AS k, unnest([CASE WHEN p_size > 25 THEN 'Y' ELSE 'N' END, p_brand, CAST(p_size AS VARCHAR) || '.5', p_type]) AS v FROM part")
def nhx_tags(spark, sf):
    """The tags of comments, of which one has no value."""
    part = table(spark, sf, "part")
    tag = lambda k, v: F.concat(F.lit(f"{k}="), v)
    comment = F.concat_ws(":", tag("D", F.when(F.col("p_size") > 25, "Y").otherwise("N")), tag("S", F.col("p_brand")), F.lit("DD"), tag("B", F.concat("p_size", F.lit(".5"))), tag("C", F.col("p_type")))
    return part.select("p_partkey", F.explode(fc.nhx_tags(comment)).alias("k", "v"))


@query("SELECT p_partkey, i, '.' || CASE WHEN i <= 26 THEN chr(CAST(96 + i AS INTEGER)) ELSE chr(CAST(96 + (i - 1) % 26 AS INTEGER)) || CASE WHEN i <= 676 THEN chr(CAST(97 + (i - 1) // 26 AS INTEGER)) ELSE chr(CAST(96 + (i - 1) // 26 % 26 AS INTEGER)) || chr(CAST(97 + (i - 1) // 676 AS INTEGER)) END END AS suffix FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)")
def tandem_repeat_suffix(spark, sf):
    """Parts of a brand are copies of one gene."""
    from synteny_spark.functions.numbers import duplication_suffix

    @F.pandas_udf("string")
    def suffix(n: pd.Series) -> pd.Series:
        return n.map(duplication_suffix)

    copies = table(spark, sf, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).cast("bigint").alias("i"))
    return copies.withColumn("suffix", suffix("i"))


# Comparison of genomes


@query(f"""WITH {GENES}, x AS (SELECT chrom, pkey, row_number() OVER (ORDER BY chrom, pos) AS k FROM g WHERE sp = 1), y AS (SELECT chrom, pkey, row_number() OVER (ORDER BY chrom, pos) AS k FROM g WHERE sp = 2)
SELECT x.k AS x, y.k AS y, x.chrom AS c1, y.chrom AS c2 FROM x JOIN y USING (pkey)""")
def dotplot_coordinates(spark, sf):
    from synteny_spark.operators.compare import dotplot

    g = genes(spark, sf).select("sp", "chrom", "pos", F.col("pkey").alias("name"))
    return dotplot(g.where("sp = 1"), g.where("sp = 2"))


@query(f"WITH {GENES}, y AS (SELECT pkey, min(chrom) c2 FROM g WHERE sp = 2 GROUP BY 1), sz AS (SELECT chrom, rank() OVER (ORDER BY count(*) DESC, chrom) rk FROM g WHERE sp = 2 GROUP BY chrom) SELECT g.chrom AS chrom, g.pos AS pos, y.c2 AS c2, sz.rk AS rank FROM g JOIN y USING (pkey) JOIN sz ON sz.chrom = y.c2 WHERE g.sp = 1")
def karyotype_rank(spark, sf):
    from synteny_spark.operators.compare import karyotype

    g = genes(spark, sf).select("sp", "chrom", "pos", F.col("pkey").alias("name"))
    return karyotype(g.where("sp = 1"), g.where("sp = 2"))


PAINT = f"""{GENES}, y AS (SELECT pkey, min(chrom % 23) c2 FROM g WHERE sp = 2 GROUP BY 1), sz AS (SELECT chrom % 23 AS c, rank() OVER (ORDER BY count(*) DESC, chrom % 23) rk FROM g WHERE sp = 2 GROUP BY 1),
pa AS (SELECT g.chrom // 50 AS chrom, g.chrom * 100 + g.pos AS pos, sz.rk AS rank FROM g JOIN y USING (pkey) JOIN sz ON sz.c = y.c2 WHERE g.sp = 1)"""


@query(f"""WITH {PAINT}, n AS (SELECT *, CASE WHEN rank <> lag(rank) OVER (PARTITION BY chrom ORDER BY pos) THEN 1 ELSE 0 END nw FROM pa), r AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) run FROM n),
s AS (SELECT chrom, run, count(*) n, min(rank) AS rank FROM r GROUP BY 1, 2 HAVING count(*) >= 2) SELECT chrom, CAST(sum(n) OVER (PARTITION BY chrom ORDER BY run ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS pos, n, rank FROM s""")
def karyotype_runs(spark, sf):
    """Stretches of two genes and more of one colour."""
    from synteny_spark.operators import compare

    g = genes(spark, sf).select("sp", "chrom", "pos", F.col("pkey").alias("name"))
    left = g.where("sp = 1").select(F.floor(F.col("chrom") / 50).alias("chrom"), (F.col("chrom") * 100 + F.col("pos")).alias("pos"), "name")
    out = compare.karyotype_runs(compare.karyotype(left, g.where("sp = 2").withColumn("chrom", F.col("chrom") % 23)), 2)
    return out.select(*big("chrom", "pos", "n", "rank"))


@query(f"WITH {ORTHO}, ll AS (SELECT chrom * 100 + pos AS gene, chrom FROM g WHERE sp = 1), rr AS (SELECT chrom * 100 + pos AS gene, chrom FROM g WHERE sp = 2), oo AS (SELECT DISTINCT a.gene AS gene1, b.gene AS gene2 FROM l a JOIN r b ON a.pkey = b.pkey) SELECT gene1, gene2, ll.chrom AS chrom1, rr.chrom AS chrom2 FROM oo LEFT JOIN ll ON ll.gene = gene1 LEFT JOIN rr ON rr.gene = gene2")
def ortholog_list(spark, sf):
    from synteny_spark.operators import compare

    left, right, _ = _sides(spark, sf)
    place = lambda g: g.select("gene", F.floor(F.col("gene") / 100).cast("bigint").alias("chrom"))
    return compare.ortholog_list(joins.orthologs(left, right), place(left), place(right))


BIP = """b AS (SELECT DISTINCT 2 * (l_suppkey * 7919 + l_linenumber * 31 + l_partkey % 97) AS x, 2 * l_partkey + 1 AS y FROM lineitem),
u AS (SELECT x AS p, y AS q FROM b UNION SELECT y, x FROM b)"""
#: Each node's least label so far, lowered along edges.
COMP = "k(node, component) USING KEY (node) AS (SELECT p, least(p, min(q)) FROM u GROUP BY p UNION SELECT u.p, min(k.component) FROM k JOIN u ON u.q = k.node JOIN recurring.k AS now ON now.node = u.p WHERE k.component < now.component GROUP BY u.p)"


def _bipartite(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select((2 * (F.col("l_suppkey") * 7919 + F.col("l_linenumber") * 31 + F.col("l_partkey") % 97)).alias("x"), (2 * F.col("l_partkey") + 1).alias("y")).distinct()


@query(f"WITH RECURSIVE {BIP}, {COMP} SELECT node, component FROM k")
def components(spark, sf):
    from synteny_spark.operators.components import components as find

    return find(_bipartite(spark, sf))


@query(f"""WITH RECURSIVE {BIP}, {COMP} SELECT component, count(*) FILTER (node % 2 = 0) AS n1, count(*) FILTER (node % 2 = 1) AS n2,
CASE WHEN count(*) FILTER (node % 2 = 0) = 1 AND count(*) FILTER (node % 2 = 1) = 1 THEN '=' WHEN count(*) FILTER (node % 2 = 1) = 1 THEN '--' WHEN count(*) FILTER (node % 2 = 0) = 1 THEN '++' ELSE '**' END AS label FROM k GROUP BY component""")
def gene_diff(spark, sf):
    from synteny_spark.operators.compare import gene_diff as find

    return find(_bipartite(spark, sf).withColumnsRenamed({"x": "gene1", "y": "gene2"}))


# Reconstruction: whole blocks of planted genomes


@query(f"WITH RECURSIVE {planted.pairs_sql('ed', True)}, {planted.greedy_sql('ac', 'SELECT * FROM ed')} SELECT ed.a, CAST(ed.sa AS BIGINT) AS sa, ed.b, CAST(ed.sb AS BIGINT) AS sb, ed.weight, ac.a IS NOT NULL AS accepted FROM ed LEFT JOIN ac ON ac.a = ed.a AND ac.sa = ed.sa AND ac.b = ed.b AND ac.sb = ed.sb")
def linear_forest(spark, sf):
    """Every adjacency, and whether the forest takes it."""
    from synteny_spark.operators.linear import forest_edges

    e = forest_edges(planted.adjacencies(spark, sf, True), 1)
    return e.select(*big("a", "sa", "b", "sb", "weight"), (F.col("verdict") == "accepted").alias("accepted"))


@query(planted.DENOVO)
def denovo_blocks(spark, sf):
    from synteny_spark.operators.linear import denovo

    return planted.flat(denovo(planted.adjacencies(spark, sf, True), planted.universe(spark, sf)))


#: So few edges of a component for a group that rounds are needed on the smallest tables.
FEW_EDGES = 500


@query(planted.MIXED_FOREST)
def denovo_mixed(spark, sf):
    """Blocks of one component of all families, in rounds."""
    from synteny_spark.operators.linear import denovo

    return planted.flat(denovo(planted.mixed_adjacencies(spark, sf), planted.universe(spark, sf), most=FEW_EDGES))


@query(planted.MIXED_VERDICTS)
def forest_verdicts(spark, sf):
    """What becomes of each edge of that component, and why."""
    from synteny_spark.operators.linear import forest_edges

    return forest_edges(planted.mixed_adjacencies(spark, sf), most=FEW_EDGES).select(*big("a", "sa", "b", "sb", "weight"), "verdict")


def _triples(spark, sf, edges: list[tuple[int, int, str]], width: int, shortcuts: bool) -> DataFrame:
    """Blocks of components of so many families, one of each part, with edges (first, second, weight) between them."""
    from synteny_spark.operators.linear import denovo

    part = table(spark, sf, "part").select((F.col("p_partkey") * width).cast("int").alias("k"), "p_size")
    edge = lambda a, b, w: F.struct((F.col("k") + a).alias("a"), F.lit(1).alias("sa"), (F.col("k") + b).alias("b"), F.lit(1).alias("sb"), F.expr(f"cast({w} as bigint)").alias("weight"))
    adj = part.select(F.lit("A0").alias("anc"), F.inline(F.array(*[edge(*e) for e in edges])))
    ids = part.select(F.lit("A0").alias("anc"), F.explode(F.sequence(F.col("k"), F.col("k") + width - 1)).alias("id"))
    return planted.flat(denovo(adj, ids, 1, shortcuts)).drop("block_id")


@query("SELECT 'A0' AS anc, CAST(3 AS BIGINT) AS n, concat_ws(' ', p_partkey * 3, p_partkey * 3 + 1, p_partkey * 3 + 2) AS ids, '1 1 1' AS strands, concat_ws(' ', p_size, p_size + 1) AS support FROM part")
def shortcut_removal(spark, sf):
    """An edge past the middle one of three families goes, though it is the heaviest."""
    return _triples(spark, sf, [(0, 1, "p_size"), (1, 2, "p_size + 1"), (0, 2, "p_size + 2")], 3, True)


@query("""SELECT 'A0' AS anc, CAST(3 AS BIGINT) AS n, concat_ws(' ', p_partkey * 4, p_partkey * 4 + 1, p_partkey * 4 + 2) AS ids, '1 1 1' AS strands, concat_ws(' ', p_size + 2, p_size + 1) AS support FROM part
UNION ALL SELECT 'A0', 1, CAST(p_partkey * 4 + 3 AS VARCHAR), '1', '' FROM part""")
def linear_hand(spark, sf):
    """The lightest edge of a ring isn't taken; a family without edges is a block of its own."""
    return _triples(spark, sf, [(0, 1, "p_size + 2"), (1, 2, "p_size + 1"), (0, 2, "p_size")], 4, False)


@query(planted.FUSION)
def fusion(spark, sf):
    """Blocks of heavy edges, joined further by all."""
    from synteny_spark.operators.linear import denovo
    from synteny_spark.operators.linear import fusion as fuse

    adj, all_ = planted.adjacencies(spark, sf, True), planted.universe(spark, sf)
    return planted.flat(fuse(checkpointed(denovo(adj, all_, 3)), adj, all_, only_singletons=False, shortcuts=False))


def _filled(spark, sf) -> DataFrame:
    """Blocks of the families that no species lacks, filled with the others."""
    from synteny_spark.operators.linear import denovo
    from synteny_spark.operators.recon import fill_in as fill

    all_ = planted.universe(spark, sf)
    sure = checkpointed(denovo(planted.adjacencies(spark, sf, False, True), all_))
    return fill(sure, planted.adjacencies(spark, sf, False), all_)


@query(planted.FILL_IN)
def fill_in(spark, sf):
    return planted.flat(_filled(spark, sf))


def _part_gaps(spark, sf, ends: str) -> tuple[DataFrame, DataFrame]:
    """Gaps between neighbours on a chromosome of the families of a condition, and all others."""
    k = table(spark, sf, "part").select(F.lit("A0").alias("anc"), F.col("p_partkey").cast("int").alias("x"))
    gaps = k.where(ends).withColumn("y", F.lead("x").over(W.partitionBy(F.expr("x div 100")).orderBy("x"))).where("y is not null")
    return gaps.select("anc", F.col("x").cast("string").alias("gap"), "x", F.lit(1).alias("sx"), "y", F.lit(1).alias("sy")), k.where(f"not ({ends})").select("anc", F.col("x").alias("id"))


@query(planted.GAP_PATHS)
def gap_paths(spark, sf):
    """The path of each gap between families that no species lacks, under each search by itself."""
    from synteny_spark.operators import gaps as gp

    gaps, inner = _part_gaps(spark, sf, "x % 7 not in (3, 4)")
    out = gp.gap_paths(gaps, planted.adjacencies(spark, sf, False), inner, ["1", "2", *planted.VALUED])
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return out.select("code", F.col("gap").cast("bigint").alias("k"), text("ids"), text("weights"))


@query(planted.GAP_WIDTHS)
def gap_widths(spark, sf):
    """How wide the way from every tenth family to the next can be, and the lightest edge that each bottleneck search finds."""
    from synteny_spark.operators import gaps as gp

    gaps, inner = _part_gaps(spark, sf, "x % 10 = 0")
    edges = checkpointed(planted.adjacencies(spark, sf, True, product=False))
    found = gp.gap_paths(gaps, edges, inner, planted.BOTTLENECKS).select("anc", "gap", "code", F.array_min("weights").alias("least"))
    return gp.widths(gaps, edges, inner).join(found, ["anc", "gap"], "left").select(F.col("gap").cast("bigint").alias("k"), "code", "width", "least")


@query(planted.INSERTION)
def insertion(spark, sf):
    from synteny_spark.operators.recon import insertion as insert

    filled = checkpointed(_filled(spark, sf))
    return planted.flat(insert(filled, filled, planted.adjacencies(spark, sf, False, product=False)))


@query(planted.SCAFFOLDS)
def scaffolds(spark, sf):
    from synteny_spark.operators.diagonals import scaffold_edges
    from synteny_spark.operators.diagonals import scaffolds as build
    from synteny_spark.operators.linear import numbered

    blocks_, seen = planted.ten_by_ten(spark, sf)
    pairs = spark.createDataFrame([("A0", x, y) for x in ("M1", "M2", "M3") for y in ("M4", "M5")], "anc string, e1 string, e2 string")
    return planted.flat(numbered(build(blocks_, scaffold_edges(checkpointed(seen), pairs), shortcuts=False)))


TURNED = """u AS (SELECT s, p_partkey AS k, p_partkey // 50 AS c, (p_partkey // 50 + s) % 4 = 0 AS back FROM part, range(1, 6) t(s)),
v AS (SELECT s, c // 20 AS chrom, k // 10 AS blk, CASE WHEN back THEN -1 ELSE 1 END AS d, min(c * 50 + CASE WHEN back THEN 49 - k % 50 ELSE k % 50 END) AS p FROM u GROUP BY ALL),
n AS (SELECT s, blk b1, d d1, lead(blk) OVER w b2, lead(d) OVER w d2 FROM v WINDOW w AS (PARTITION BY s, chrom ORDER BY p)),
e AS (SELECT CASE WHEN s <= 3 THEN 1 ELSE 2 END grp, CASE WHEN b1 < b2 THEN b1 ELSE b2 END a, CASE WHEN b1 < b2 THEN d1 ELSE -d2 END sa, CASE WHEN b1 < b2 THEN b2 ELSE b1 END b, CASE WHEN b1 < b2 THEN d2 ELSE -d1 END sb FROM n WHERE b2 IS NOT NULL),
f AS (SELECT a, sa, b, sb, grp, count(*) n FROM e GROUP BY ALL)"""


@query(f"WITH {TURNED} SELECT a, CAST(sa AS BIGINT) sa, b, CAST(sb AS BIGINT) sb, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) weight FROM f GROUP BY a, sa, b, sb HAVING weight > 0")
def block_adjacencies(spark, sf):
    """Parts in the order of their keys are the ancestor's genes, ten a block; each species has some stretches of fifty turned round."""
    from synteny_spark.operators.diagonals import adjacency_weights
    from synteny_spark.operators.synteny import block_adjacencies as adjacency_evidence

    k = F.col("p_partkey")
    c, species = F.floor(k / 50), spark.range(1, 6).withColumnRenamed("id", "s")
    back = (c + F.col("s")) % 4 == 0
    each = table(spark, sf, "part").select("p_partkey").crossJoin(F.broadcast(species)).select(F.lit("A0").alias("anc"), F.concat(F.lit("M"), "s").alias("species"), k.cast("int").alias("fam"), c.alias("c"), back.alias("back"))  # five species
    place = F.col("c") * 50 + F.when(F.col("back"), 49 - F.col("fam") % 50).otherwise(F.col("fam") % 50)
    extant = each.select("anc", "species", F.floor(F.col("c") / 20).cast("string").alias("chrom"), place.alias("idx"), "fam", F.when(F.col("back"), -1).otherwise(1).alias("strand"))
    own = each.select("anc", "species", F.floor(F.col("fam") / 10).cast("int").alias("block_id"), (F.col("fam") % 10).alias("idx"), "fam", F.lit(1).alias("strand"))
    out = adjacency_weights(adjacency_evidence(extant, own, 3), SpeciesTree.read(TREE).groups(spark))
    return out.select(*big("a", "sa", "b", "sb", "weight"))


# Gene trees, made from part ids: a family of each part, with a gene in each species that a digit names


def _forest(spark, sf) -> DataFrame:
    """A tree (((M1,M2)A3,M3)A1,(M4,M5)A2)A0 for each part; every third has a duplication above M1 and M2, every fifth lacks M4."""
    nodes = [("A0", None, 0, 0), ("A1", "A0", 0, 0), ("A2", "A0", 1, 0), ("A3", "A1", 0, 0), ("M3", "A1", 1, 1), ("M4", "A2", 0, 1), ("M5", "A2", 1, 1), ("M1", "A3", 0, 1), ("M2", "A3", 1, 1)]
    number = {n: i for i, (n, *_) in enumerate(nodes)}
    rows = [(number[n], number.get(p), o, n, leaf == 1) for n, p, o, leaf in nodes]
    shape = spark.createDataFrame(rows, "node_id int, parent_id int, child_ord int, taxon string, leaf boolean")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("tree_id"))
    t = parts.crossJoin(F.broadcast(shape)).where("not (tree_id % 5 = 0 and taxon = 'M4')")  # nine rows
    dup = F.when((F.col("tree_id") % 3 == 0) & (F.col("taxon") == "A3"), 2).otherwise(0).alias("dup")
    gene = F.when(F.col("leaf"), F.concat("taxon", F.lit("_"), "tree_id")).alias("gene_name")
    return t.select("tree_id", "node_id", "parent_id", "child_ord", F.lit(1.0).alias("branch_len"), "taxon", dup, gene, F.concat(F.lit("Fam"), "tree_id").alias("tree_name"))


#: Families of each tree in the order in which they are made: inner ones before those around them.
MADE = """p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS split, p_partkey % 5 = 0 AS lost FROM part),
m AS (SELECT k, s, 'M' || s || '_' || k AS gene FROM p, range(1, 6) t(s) WHERE NOT (lost AND s = 4)),
made AS (SELECT k, CASE s WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 5 WHEN 4 THEN 7 ELSE 8 END AS ord, 'M' || s AS anc, CASE WHEN split AND s <= 2 THEN 'Fam' || k || CASE s WHEN 1 THEN '.a' ELSE '.b' END ELSE 'Fam' || k END AS name, gene AS members FROM m JOIN p USING (k)
UNION ALL SELECT k, 4, 'A3', 'Fam' || k, 'M1_' || k || ' M2_' || k FROM p WHERE NOT split
UNION ALL SELECT k, 2, 'A3', 'Fam' || k || '.a', 'M1_' || k FROM p WHERE split UNION ALL SELECT k, 3, 'A3', 'Fam' || k || '.b', 'M2_' || k FROM p WHERE split
UNION ALL SELECT k, 6, 'A1', 'Fam' || k, 'M1_' || k || ' M2_' || k || ' M3_' || k FROM p
UNION ALL SELECT k, 9, 'A2', 'Fam' || k, CASE WHEN lost THEN '' ELSE 'M4_' || k || ' ' END || 'M5_' || k FROM p
UNION ALL SELECT k, 10, 'A0', 'Fam' || k, 'M1_' || k || ' M2_' || k || ' M3_' || k || CASE WHEN lost THEN '' ELSE ' M4_' || k END || ' M5_' || k FROM p)"""


@query(f"WITH {MADE} SELECT anc, row_number() OVER (PARTITION BY anc ORDER BY k, ord) - 1 AS fam_idx, name, members FROM made")
def family_extraction(spark, sf):
    """Every family: its number, name and genes."""
    from synteny_spark.operators.genetrees import extract_families

    f = extract_families(_forest(spark, sf), SpeciesTree.read(TREE))
    return f.select("anc", F.col("fam_idx").cast("bigint").alias("fam_idx"), "name", F.array_join("members", " ").alias("members"))


@query(f"""WITH {MADE}, n AS (SELECT anc, row_number() OVER (PARTITION BY anc ORDER BY k, ord) - 1 AS fam_idx, name, members, split, lost FROM made JOIN p USING (k) WHERE anc LIKE 'A%')
SELECT anc, fam_idx, name, CASE WHEN anc = 'A0' AND (split OR lost) OR anc IN ('A1', 'A3') AND split OR anc = 'A2' AND lost THEN '' ELSE members END AS members FROM n""")
def family_filter(spark, sf):
    """Families of all species below their ancestor, once each, with the others emptied. Parts without a gene of M4 lose A0 and A2;
    those whose A3 family split lose its halves, and so A1 and A0."""
    from synteny_spark.operators.genetrees import extract_families
    from synteny_spark.operators.genetrees import filter_families as keep

    tree = SpeciesTree.read(TREE)
    f = keep(checkpointed(extract_families(_forest(spark, sf), tree)), tree, 1.0, 1.0)
    return f.select("anc", F.col("fam_idx").cast("bigint").alias("fam_idx"), "name", F.array_join("members", " ").alias("members"))


def _edit(spark, sf, edit) -> DataFrame:
    from synteny_spark.operators.genetrees import edited

    return edited(_forest(spark, sf), edit)


def forest_sql(taxon: str, dup: str, gene: str, keep: str = "true") -> str:
    """The trees' nodes with what an edit makes of them: expressions over tree_id, node_id, taxon, dup, gene and alone (M5 has lost its
    sister, and is its parent's only child)."""
    return f"""WITH shape AS (SELECT * FROM (VALUES (0, NULL, 0, 'A0', false), (1, 0, 0, 'A1', false), (2, 0, 1, 'A2', false), (3, 1, 0, 'A3', false), (4, 1, 1, 'M3', true), (5, 2, 0, 'M4', true), (6, 2, 1, 'M5', true), (7, 3, 0, 'M1', true), (8, 3, 1, 'M2', true)) v(node_id, parent_id, child_ord, taxon, leaf)),
t AS (SELECT p_partkey AS tree_id, *, p_partkey % 5 = 0 AS alone, CASE WHEN p_partkey % 3 = 0 AND taxon = 'A3' THEN 2 ELSE 0 END AS dup, CASE WHEN leaf THEN taxon || '_' || p_partkey END AS gene FROM part, shape WHERE NOT (p_partkey % 5 = 0 AND taxon = 'M4'))
SELECT tree_id, node_id, parent_id, CASE WHEN alone AND taxon = 'M5' THEN 0 ELSE child_ord END AS child_ord, CASE WHEN node_id = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS branch_len, {taxon} AS taxon, {dup} AS dup, {gene} AS gene_name, 'Fam' || tree_id AS tree_name FROM t WHERE {keep}"""


ALONE = "CASE WHEN alone AND node_id = 2 THEN 'M5' ELSE taxon END"


@query(f"""WITH f AS ({forest_sql("taxon", "dup", "gene")}), k AS (SELECT p_partkey AS tree_id, row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part)
SELECT line, f.taxon AS taxon, p.taxon AS above, CAST(f.child_ord AS BIGINT) AS child_ord, f.branch_len AS branch_len, CAST(f.dup AS BIGINT) AS dup, f.gene_name AS gene_name FROM f JOIN k USING (tree_id) LEFT JOIN f AS p ON p.tree_id = f.tree_id AND p.node_id = f.parent_id""")
def forest_filed(spark, sf):
    """Gene trees written a line each and read again: a tree's number is its line."""
    lines = sinks.forest_lines(_forest(spark, sf)).select(F.lit("F").alias("anc"), F.col("tree_id").alias("ord"), "value")
    read = checkpointed(readers.read_forest(spark, _filed(spark, lines, "F")))
    above = read.select("tree_id", F.col("node_id").alias("parent_id"), F.col("taxon").alias("above"))
    return read.join(above, ["tree_id", "parent_id"], "left").select(F.col("tree_id").alias("line"), "taxon", "above", F.col("child_ord").cast("bigint").alias("child_ord"), "branch_len", F.col("dup").cast("bigint").alias("dup"), "gene_name")


@query(forest_sql(ALONE, "dup", "CASE WHEN alone AND node_id = 2 THEN 'M5_' || tree_id ELSE gene END", "NOT (alone AND node_id = 6)"))
def tree_compact(spark, sf):
    from synteny_spark.operators.genetrees import compact

    return _edit(spark, sf, compact)


@query(forest_sql(ALONE, "dup", "gene"))
def tree_rename(spark, sf):
    from synteny_spark.operators.genetrees import rename

    tree = SpeciesTree.read(TREE)
    return _edit(spark, sf, lambda t: rename(t, tree))


def _unflat(spark, sf) -> DataFrame:
    """The trees with A3 named A1, as if M1, M2 and M3 had come apart at once."""
    return _forest(spark, sf).withColumn("taxon", F.when((F.col("taxon") == "A3") & (F.col("dup") == 0), "A1").otherwise(F.col("taxon")))


@query(forest_sql(ALONE, "dup", "gene"))
def tree_flatten(spark, sf):
    """A node's name is its children's before it is flattened, so A3 gets its own again."""
    from synteny_spark.operators.genetrees import edited, flatten

    tree = SpeciesTree.read(TREE)
    return edited(_unflat(spark, sf), lambda t: flatten(t, tree))


@query(forest_sql(ALONE, "CASE WHEN alone AND node_id = 2 THEN 3 ELSE dup END", "gene"))
def tree_rebuild(spark, sf):
    """A node over one species, which has no sub-tree to tell its children apart, is a duplication."""
    from synteny_spark.operators.genetrees import flatten, rebuild

    tree = SpeciesTree.read(TREE)
    return _edit(spark, sf, lambda t: (flatten(t, tree), rebuild(t, tree, lambda *_: False)))


@query(forest_sql(ALONE, "CASE WHEN alone AND node_id = 2 THEN 3 ELSE 0 END", "gene"))
def duplication_edit(spark, sf):
    """The duplication above M1 and M2 has no species on both sides, and becomes a speciation."""
    from synteny_spark.operators.genetrees import edit_duplications

    tree = SpeciesTree.read(TREE)
    return _edit(spark, sf, lambda t: edit_duplications(t, tree, 0.3))
