"""Command line: reconstructs ancestral genomes from files.

    python -m synteny_spark TREE --genes genes.%s.bz2 (--trees FOREST | --families fam.%s | --groups og.%s) [--preset vertebrates | --ini FILE] --out FOLDER
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synteny_spark.operators.genetrees import extract_families, ingest_groups
from synteny_spark.operators.trees import SpeciesTree
from synteny_spark.operators.windows import dense_index
from synteny_spark.plans import workflow
from synteny_spark.plans.cluster import send_package
from synteny_spark.sources import readers, sinks
from synteny_spark.sources.files import open_text, readable

PRESETS = {"basic": workflow.basic, "vertebrates": workflow.vertebrates, "plants": workflow.plants, "generic": workflow.generic}


def all_families(spark: SparkSession, tree: SpeciesTree, template: str) -> DataFrame:
    """Families of all nodes that have a file."""
    out = None
    for node in tree.ord:
        if readable(template % tree.file_name(node)):
            f = readers.read_families(spark, template % tree.file_name(node), node)
            out = f if out is None else out.unionByName(f)
    return out


def with_extant(families: DataFrame, genes: DataFrame) -> DataFrame:
    """families, and each gene of a species that has none as a family of its own."""
    missing = genes.join(families.select(F.col("anc").alias("species")).distinct(), "species", "left_anti")
    own = missing.select(F.col("species").alias("anc"), F.xxhash64("species", "name").alias("k"), "name")
    numbered = dense_index(own, "anc", F.pmod("k", F.lit(1024)), ["name"], "fam_idx")
    return families.unionByName(numbered.select("anc", "fam_idx", F.lit(None).cast("string").alias("name"), F.array("name").alias("members")))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    send_package(spark)
    with open_text(args.tree) as f:
        tree = SpeciesTree.read(f.read())
    read = readers.read_species(spark, args.genes, tree.species).where("contig_type in ('Chromosome', 'Scaffold')")
    genes = read.select(F.col("genome").alias("species"), "chrom", "idx", F.element_at("names", -1).alias("name"), F.coalesce(F.col("strand").cast("int"), F.lit(0)).alias("strand"))
    if args.trees:
        families = extract_families(readers.read_forest(spark, args.trees), tree, args.reuse_names)
    elif args.families:
        families = all_families(spark, tree, args.families)
    else:
        groups = None
        for a in tree.ancestors:
            g = readers.read_groups(spark, args.groups % a, a)
            groups = g if groups is None else groups.unionByName(g)
        families = ingest_groups(groups, genes.select("species", "name"), tree.closure(spark))
        genes = genes.withColumn("name", F.concat_ws(".", "species", "name"))
    r = workflow.Reconstruction(tree, genes, with_extant(families, genes), args.target, f"{args.out}/steps", args.force)
    if args.ini:
        with open_text(args.ini) as f:
            workflow.run_ini(r, f)
    else:
        PRESETS[args.preset](r)
    Path(args.out, "steps.dot").write_text(r.graph())
    for step in [s for s in r.steps.values() if s.kind == "genomes"]:
        sinks.text_files(sinks.genome_lines(step.table), f"{args.out}/genomes/{step.name}", args.compression)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="synteny_spark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("tree")
    p.add_argument("--genes", required=True)
    source = p.add_mutually_exclusive_group(required=True)
    for name in ("trees", "families", "groups"):
        source.add_argument(f"--{name}")
    p.add_argument("--preset", choices=PRESETS, default="vertebrates")
    p.add_argument("--ini")
    p.add_argument("--target")
    p.add_argument("--out", required=True)
    p.add_argument("--compression", default="none", choices=("none", "bzip2", "gzip"))
    p.add_argument("--reuse-names", action="store_true")
    p.add_argument("--force", action="store_true")
    run(SparkSession.builder.appName("synteny_spark").getOrCreate(), p.parse_args(argv))


if __name__ == "__main__":
    main()
