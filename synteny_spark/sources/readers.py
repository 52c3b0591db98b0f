"""DataFrame readers of genomes, families, adjacencies, blocks and gene trees."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synteny_spark.functions.columns import chromosome_number, contig_type
from synteny_spark.operators.genetrees import DUBIOUS, DUPLICATION, NODES, SPECIATION
from synteny_spark.sources.files import data_lines, first_line, sniff_file, tsv
from synteny_spark.sources.newick import parse


def _indexed(genes: DataFrame, genome: str) -> DataFrame:
    """Genes with their idx from 0 in the order of place, strand and names, and the kind of their contig."""
    order = W.partitionBy("genome", "chrom").orderBy("beg", "end", "strand", "names")
    full = genes.select(F.lit(genome).alias("genome"), "chrom", contig_type(F.col("chrom")).alias("contig_type"), "beg", "end", F.col("strand").cast("tinyint").alias("strand"), "names")
    return full.withColumn("idx", F.row_number().over(order) - 1).select("genome", "chrom", "contig_type", "idx", "beg", "end", "strand", "names")


def read_genes(spark: SparkSession, path: str, genome: str) -> DataFrame:
    """chromosome, begin, end, strand, names, more columns: a strand `None` is null."""
    c = F.split("value", "\t")
    at = lambda k: F.get(c, F.lit(k))
    names = F.filter(F.split(at(4), " "), lambda x: x != "")
    rows = data_lines(spark, path).select(at(0).alias("chrom"), at(1).cast("long").alias("beg"), at(2).cast("long").alias("end"), at(3).try_cast("int").alias("strand"), names.alias("names"))
    return _indexed(rows, genome)


def read_grimm(spark: SparkSession, path: str, genome: str) -> DataFrame:
    """A chromosome for each line that ends with $, of signed names, numbered from 1."""
    lines = data_lines(spark, path).where("not startswith(value, '>')").withColumn("chrom", F.row_number().over(W.orderBy("line")).cast("string"))  # one file
    each = lines.select("chrom", F.posexplode(F.filter(F.split(F.replace("value", F.lit("$"), F.lit("")), r"\s+"), lambda x: x != "")).alias("beg", "t"))
    return _indexed(each.select("chrom", F.col("beg").cast("long").alias("beg"), (F.col("beg") + 1).cast("long").alias("end"), F.when(F.col("t").startswith("-"), -1).otherwise(1).alias("strand"), F.array(F.regexp_replace("t", "^[-+]", "")).alias("names")), genome)


def read_chromosome_names(spark: SparkSession, path: str, genome: str) -> DataFrame:
    """chromosome and names: places count along a run of one chromosome."""
    from synteny_spark.operators.windows import run_offset

    c = F.split("value", "\t")
    rows = data_lines(spark, path).select("path", "line", F.get(c, F.lit(0)).alias("chrom"), F.split(F.get(c, F.lit(1)), " ").alias("names"))
    placed = run_offset(rows, ["path"], ["line"], "chrom", "beg")
    return _indexed(placed.select("chrom", F.col("beg").cast("long").alias("beg"), (F.col("beg") + 1).cast("long").alias("end"), F.lit(0).alias("strand"), "names"), genome)


def read_signed_rows(spark: SparkSession, path: str, genome: str, kind: str) -> DataFrame:
    """Rows of ids and strands: with chromosome and strand before them (a negative strand turns the row round), alone, or as
    blocks; ids become names."""
    c = F.split("value", "\t")
    ids, strands, chrom = {
        "signed_chromosomes": (2, 3, F.get(c, F.lit(0))),
        "ids_strands": (0, 1, (F.col("line") + 1).cast("string")),
        "blocks": (2, 3, (F.col("line") + 1).cast("string")),
    }[kind]
    words = lambda k: F.filter(F.split(F.get(c, F.lit(k)), " "), lambda x: x != "")
    back = F.get(c, F.lit(1)).try_cast("int") < 0 if kind == "signed_chromosomes" else F.lit(False)
    rows = data_lines(spark, path).select(chrom.alias("chrom"), back.alias("back"), words(ids).alias("i"), F.transform(words(strands), lambda s: s.cast("int")).alias("s"))
    turned = rows.select("chrom", F.when(F.col("back"), F.reverse("i")).otherwise(F.col("i")).alias("i"), F.when(F.col("back"), F.transform(F.reverse("s"), lambda s: -s)).otherwise(F.col("s")).alias("s"))
    each = turned.select("chrom", F.posexplode(F.arrays_zip("i", "s")).alias("beg", "x"))
    return _indexed(each.select("chrom", F.col("beg").cast("long").alias("beg"), (F.col("beg") + 1).cast("long").alias("end"), F.col("x.s").alias("strand"), F.array("x.i").alias("names")), genome)


def read_genome(spark: SparkSession, path: str, genome: str, kind: str | None = None) -> DataFrame:
    """Any gene file; the format is told by the first line unless it is given."""
    kind = kind or sniff_file(spark, path)
    if kind == "families":
        raise ValueError("a family file has no places; read it with read_families")
    plain = {"genes": read_genes, "grimm": read_grimm, "chromosome_names": read_chromosome_names}
    return plain[kind](spark, path, genome) if kind in plain else read_signed_rows(spark, path, genome, kind)


def read_species(spark: SparkSession, template: str, species: Iterable[str]) -> DataFrame:
    """The genomes of many species, from files named by a template with %s."""
    out = None
    for s in species:
        g = read_genome(spark, template % s, s)
        out = g if out is None else out.unionByName(g)
    return out


def gene_index(genes: DataFrame) -> DataFrame:
    """name, genome, chrom, idx of every name of every gene; of a name that occurs more than once the last place."""
    each = genes.select(F.explode("names").alias("name"), "genome", "chrom", "idx")
    return each.groupBy("name").agg(F.max(F.struct("genome", "chrom", "idx")).alias("at")).select("name", "at.*")


def read_families(spark: SparkSession, path: str, anc: str) -> DataFrame:
    """Families of one ancestor; identity is the line, from 0."""
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return data_lines(spark, path).select(F.lit(anc).alias("anc"), F.col("line").cast("int").alias("fam_idx"), F.get(words, F.lit(0)).alias("name"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("members"))


def read_groups(spark: SparkSession, path: str, anc: str) -> DataFrame:
    """Orthology groups: anc, line (from 1), members."""
    return data_lines(spark, path).select(F.lit(anc).alias("anc"), (F.col("line") + 1).cast("int").alias("line"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("members"))


def read_adjacencies(spark: SparkSession, path: str, anc: str, least: int = 0) -> DataFrame:
    rows = tsv(spark, path, "a int, sa int, b int, sb int, weight long").where(F.col("weight") >= least)
    return rows.select(F.lit(anc).alias("anc"), "a", "sa", "b", "sb", "weight")


def read_old_adjacencies(spark: SparkSession, path: str, targets: Iterable[str]) -> DataFrame:
    """The older table for several ancestors, whose weight is the eighth column, after the ends in columns two to five."""
    c = F.split("value", "\t")
    at = lambda k: F.get(c, F.lit(k))
    rows = data_lines(spark, path).where(at(0).isin(*targets))
    return rows.select(at(0).alias("anc"), at(1).cast("int").alias("a"), at(2).cast("int").alias("sa"), at(3).cast("int").alias("b"), at(4).cast("int").alias("sb"), at(7).cast("long").alias("weight"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """anc, block_id (the line, from 1), n, ids, strands, support (as text: it may be in brackets); emptied blocks stay."""
    c = F.split("value", "\t")
    words = lambda k: F.filter(F.split(F.coalesce(F.get(c, F.lit(k)), F.lit("")), " "), lambda x: x != "")
    ints = lambda k: F.transform(words(k), lambda x: x.cast("int"))
    return data_lines(spark, path).select(F.get(c, F.lit(0)).alias("anc"), (F.col("line") + 1).cast("int").alias("block_id"), F.get(c, F.lit(1)).cast("int").alias("n"), ints(2).alias("ids"), ints(3).alias("strands"), words(4).alias("support"))


def duplication_state(tags: dict[str, str]) -> int:
    """D=Y is a duplication, a doubted one with DD=Y; anything else a speciation."""
    return (DUBIOUS if tags.get("DD") == "Y" else DUPLICATION) if tags.get("D") == "Y" else SPECIATION


def nhx_rows(text: str, tree_id: int) -> Iterator[tuple]:
    """Node rows of one NHX tree, numbered in pre-order."""
    root = parse(text)
    number = {id(n): i for i, (n, _) in enumerate(root.walk())}
    for node, parent in root.walk():
        place = next((k for k, c in enumerate(parent.children) if c is node), 0) if parent else 0
        yield (tree_id, number[id(node)], number[id(parent)] if parent else None, place, node.length, node.tags.get("S"), duplication_state(node.tags), node.name if not node.children else None, f"Fam{tree_id + 1:06d}")


def native_rows(text: str, tree_id: int) -> Iterator[tuple]:
    """Node rows of one tree in the indented format: for each node a line `id`, one of its `info` (a dictionary) and, for inner
    nodes, `len` lines of the branches to the children, which follow a tab deeper."""
    stack: list[tuple[int, int]] = []
    node = None
    kids: dict[int, int] = {}
    length = 0.0
    for line in text.splitlines():
        depth, (key, _, value) = len(line) - len(line.lstrip("\t")), line.strip().partition("\t")
        if key == "len":
            length = float(value)
        elif key == "id":
            node = int(value)
        elif key == "info":
            while stack and stack[-1][0] >= depth:
                stack.pop()
            info, parent = ast.literal_eval(value), stack[-1][1] if stack else None
            place = kids.get(parent, 0)
            kids[parent] = place + 1
            yield (tree_id, node, parent, place, length, info.get("taxon_name"), int(info.get("Duplication", 0)), info.get("gene_name"), info.get("tree_name") or f"Fam{tree_id + 1:06d}")
            stack.append((depth, node))
            length = 0.0


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a forest of gene trees: NHX, a tree a line, or the indented format, told by the first line."""
    if set(first_line(spark, path)) & set("(;"):
        lines = data_lines(spark, path)

        def rows(batches):
            import pandas as pd

            for pdf in batches:
                made = [r for n, t in zip(pdf["line"], pdf["value"]) for r in nhx_rows(t, n)]
                yield pd.DataFrame(made, columns=[x.split(" ")[0] for x in NODES.split(", ")]).astype({"parent_id": "Int64"})

        return lines.select("line", "value").mapInPandas(rows, NODES)
    lines = data_lines(spark, path).withColumn("tree_id", F.sum(F.when(F.col("value").startswith("id\t"), 1).otherwise(0)).over(W.partitionBy("path").orderBy("line")) - 1)
    whole = lines.groupBy("tree_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))

    def native(batches):
        import pandas as pd

        for pdf in batches:
            made = [r for n, t in zip(pdf["tree_id"], pdf["value"]) for r in native_rows(t, n)]
            yield pd.DataFrame(made, columns=[x.split(" ")[0] for x in NODES.split(", ")]).astype({"parent_id": "Int64"})

    return whole.mapInPandas(native, NODES)


def with_number(genes: DataFrame) -> DataFrame:
    return genes.withColumn("chrom_number", chromosome_number(F.col("chrom")))
