"""Writers: Parquet by ancestor for whatever is read again, text in the exchange formats for people and other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synteny_spark.operators.genetrees import GeneTree, per_tree


def by_ancestor(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A Parquet folder for each ancestor; others of the same table stay when one is written again."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("anc").parquet(path)


def _words(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def family_lines(families: DataFrame) -> DataFrame:
    """anc, ord, value: the name and the members; an emptied family keeps its line."""
    return families.select("anc", F.col("fam_idx").alias("ord"), F.concat_ws(" ", F.array("name"), "members").alias("value"))


def adjacency_lines(adjacencies: DataFrame) -> DataFrame:
    return adjacencies.select("anc", F.struct("a", "sa", "b", "sb").alias("ord"), F.concat_ws("\t", "a", "sa", "b", "sb", "weight").alias("value"))


def block_lines(blocks: DataFrame) -> DataFrame:
    return blocks.select("anc", F.col("block_id").alias("ord"), F.concat_ws("\t", "anc", "n", _words("ids"), _words("strands"), _words("support")).alias("value"))


def genome_lines(genes: DataFrame) -> DataFrame:
    """An ancestral genome as published: block, begin, end, strand, names."""
    return genes.select("anc", F.struct("block", "beg").alias("ord"), F.concat_ws("\t", "block", "beg", "end", "strand", "names").alias("value"))


def gene_lines(genes: DataFrame) -> DataFrame:
    """A genome in the gene-list format."""
    value = F.concat_ws("\t", "chrom", "beg", "end", F.coalesce(F.col("strand").cast("string"), F.lit("None")), F.array_join("names", " "))
    return genes.select(F.col("genome").alias("anc"), F.struct("chrom", "idx").alias("ord"), value.alias("value"))


def mysql_lines(df: DataFrame, *columns: str) -> DataFrame:
    r"""Rows of a dump; null is \N."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]).alias("value"))


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")).alias("value"))


def text_files(lines: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of text for each ancestor, its lines in order: an ancestor is dealt to as many tasks as it needs, each of which writes
    the part that comes next, so parts in the order of their names are the whole."""
    ranged = lines.repartitionByRange("anc", "ord").sortWithinPartitions("anc", "ord")
    ranged.select("anc", "value").write.mode("overwrite").option("compression", compression).partitionBy("anc").text(path)


def to_nhx(t: GeneTree, ancestral_names: dict[int, str] | None = None) -> str:
    """The tree as one NHX line, inner nodes with a name if they have one."""
    text: dict[int, str] = {}
    length = {c: d for kids in t.children.values() for c, d in kids}
    for n in t.post_order():
        inner = "(" + ",".join(text[c] for c, _ in t.children[n]) + ")" if n in t.children else ""
        name = t.gene.get(n, "") if n not in t.children else (ancestral_names or {}).get(n, "")
        state = ":D=" + ("Y" if t.dup.get(n, 0) else "N") + (":DD=Y" if t.dup.get(n, 0) == 1 else "") if inner else ""
        text[n] = f"{inner}{name}" + (f":{length[n]:g}" if n in length else "") + f"[&&NHX:S={t.taxon[n]}{state}]"
    return text[t.root] + ";"


def forest_lines(nodes: DataFrame) -> DataFrame:
    """tree_id and value, a line for each tree."""
    return per_tree(nodes, lambda t, k: [(k, to_nhx(t))], "tree_id long, value string")


def to_native(t: GeneTree) -> str:
    """The tree in the indented format."""
    out, todo = [], [(t.root, 0, None)]
    while todo:
        n, depth, length = todo.pop()
        pad = "\t" * depth
        if length is not None:
            out.append(f"{pad}len\t{length:g}")
        info = {"taxon_name": t.taxon[n], "Duplication": t.dup.get(n, 0)} | ({"gene_name": t.gene[n]} if n not in t.children else {}) | ({"tree_name": t.name} if not depth else {})
        out += [f"{pad}id\t{n}", f"{pad}info\t{info!r}"]
        todo += [(c, depth + 1, d) for c, d in reversed(t.children.get(n, []))]
    return "\n".join(out)


def drawing(points: DataFrame, size: float = 20.0) -> DataFrame:
    """Dot-plot points (x, y, c1, c2) scaled to a page of this size: what a plotting program needs; drawing is left to it."""
    top = points.agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    return points.crossJoin(F.broadcast(top)).select((F.col("x") / F.col("mx") * size).alias("x"), (F.col("y") / F.col("my") * size).alias("y"), "c1", "c2")  # one row
