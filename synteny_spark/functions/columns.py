"""Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What chromosome names say about the kind of contig.
UNKNOWN_NAMES = ("Un_random", "UNKN", "Un")
SCAFFOLD_NAMES = ("U", "E64", "2-micron")
SCAFFOLD_PARTS = ("cont", "scaff", "ultra", "reftig", "_", "un", "gl", "ki", "jh", "aaex", "aadn")


def chromosome_number(name: Column) -> Column:
    """The name as an integer where it is one, else null."""
    return F.when(name.rlike("^[0-9]+$"), name.try_cast("bigint"))


def contig_type(name: Column) -> Column:
    """Chromosome, Scaffold, Random or Unknown; names are compared without case where they hold a mark."""
    low, number = F.lower(name), chromosome_number(name)
    return (
        F.when(name.isNull() | name.isin(*UNKNOWN_NAMES), "Unknown")
        .when(number.isNotNull(), F.when(number < 100, "Chromosome").otherwise("Scaffold"))
        .when(low.contains("rand"), "Random")
        .when(low.rlike("|".join(SCAFFOLD_PARTS)) | name.isin(*SCAFFOLD_NAMES) | name.endswith("Het"), "Scaffold")
        .otherwise("Chromosome")
    )


def chromosome_order(name: Column) -> list[Column]:
    """Sort keys: numbers by value, then names."""
    number = chromosome_number(name)
    return [number.isNull(), number, name]


def reverse_strand(strand: Column) -> Column:
    """Opposite strand; an unknown strand (0) is told from its reverse by the value 10."""
    return F.when(strand == 0, 10).when(strand == 10, 0).otherwise(-strand)


def reversed_block(ids: Column, strands: Column) -> tuple[Column, Column]:
    return F.reverse(ids), F.transform(F.reverse(strands), lambda s: -s)


def canonical_pair(f1: Column, s1: Column, f2: Column, s2: Column) -> list[Column]:
    """a, sa, b, sb: the oriented pair read from its lesser element on."""
    forward = f1 < f2
    return [
        F.when(forward, f1).otherwise(f2).alias("a"),
        F.when(forward, s1).otherwise(-s2).alias("sa"),
        F.when(forward, f2).otherwise(f1).alias("b"),
        F.when(forward, s2).otherwise(-s1).alias("sb"),
    ]


def natural_key(text: Column, width: int = 20) -> Column:
    """A string whose order is the natural one: digit runs are padded with zeros; longer ones come after these, by their length."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), 1)
    long = lambda p: F.concat(F.lit(":"), F.lpad(F.char_length(p).cast("string"), 9, "0"), p)
    padded = lambda p: F.when(F.char_length(p) > width, long(p)).otherwise(F.lpad(p, width, "0"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), padded(p)).otherwise(p)), "")


def nhx_tags(comment: Column) -> Column:
    """k=v:k=v as a map; parts without a value are left out."""
    return F.map_filter(F.str_to_map(comment, F.lit(":"), F.lit("=")), lambda _, v: v.isNotNull())


def ratio_abs(r: Column) -> Column:
    return F.greatest(r, 1 / r)
