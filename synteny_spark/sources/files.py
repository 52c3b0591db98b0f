"""Opening files: codecs, zip members, the first line, and what format a gene file has."""

from __future__ import annotations

import bz2
import contextlib
import gzip
import io
import lzma
import os
import sys
import urllib.request
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synteny_spark.operators.windows import dense_index

CODECS = {".bz2": bz2.open, ".gz": gzip.open, ".xz": lzma.open, ".lzma": lzma.open}
SPARK_CODECS = (".bz2", ".gz")


def open_text(name, mode: str = "r") -> IO[str]:
    """A text stream by name: compressed by suffix, a member as archive.zip/member, http(s) and ftp, - for standard in or out; an
    open one passes through. Folders are made for writing."""
    if not isinstance(name, (str, os.PathLike)):
        return name
    name = os.fspath(name)
    if name == "-":
        return sys.stdin if "r" in mode else sys.stdout
    if name.startswith(("http://", "https://", "ftp://")):
        return io.TextIOWrapper(urllib.request.urlopen(name))  # noqa: S310
    archive, zipped, member = name.partition(".zip/")
    if zipped and "r" in mode:
        return io.TextIOWrapper(zipfile.ZipFile(f"{archive}.zip").open(member))
    if "r" not in mode and os.path.dirname(name):
        os.makedirs(os.path.dirname(name), exist_ok=True)
    opener = next((f for suffix, f in CODECS.items() if name.endswith(suffix)), None)
    return opener(name, f"{mode[0]}t") if opener else open(name, mode)


def readable(name: str) -> bool:
    return os.access(name, os.R_OK)


def content_lines(lines: Iterable[str]) -> Iterator[str]:
    """Lines without their ends; blank ones and comments left out."""
    for line in lines:
        line = line.rstrip("\r\n")
        if line.strip() and not line.startswith("#"):
            yield line


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0) and value of files in their order. The part files that a Spark job wrote into one folder are one text, in the order of
    their names, and path is the folder. Lines are numbered within the stretch of a file that a task reads, and only the stretches'
    counts meet. xz and lzma files, which Spark would read as they are, are unpacked whole, each on one executor."""
    if not path.endswith((".xz", ".lzma")):
        read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        whole = read.withColumn("path", F.regexp_replace("file", "/part-[0-9]+[^/]*$", ""))
        return dense_index(whole, "path", F.struct("file", "start"), ["at"], "line", "bigint").select("path", "line", "value")

    def numbered(batches):
        import pandas as pd

        for pdf in batches:
            for raw, name in zip(pdf["content"], pdf["path"]):
                suffix = next((s for s in CODECS if name.endswith(s)), None)
                stream = CODECS[suffix](io.BytesIO(raw), "rt") if suffix else io.StringIO(bytes(raw).decode("utf-8"))
                lines = [x.rstrip("\r\n") for x in stream]
                yield pd.DataFrame({"path": name, "line": range(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(numbered, "path string, line long, value string")


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark, path).where("trim(value) <> '' and not startswith(value, '#')")


def sniff(first: str) -> str:
    """The format of a gene file by its first line that holds data; the first test that holds decides."""
    c = first.split("\t")
    if first.startswith(">") or first.rstrip().endswith("$"):
        return "grimm"
    if len(c) == 1:
        return "families"
    if len(c) == 2 and set(c[1]) - set("01-"):
        return "chromosome_names"
    if len(c) >= 5 and " " not in c[3] and c[4]:
        return "genes"
    if len(c) == 4:
        with contextlib.suppress(ValueError):
            if int(c[1]) < 2:
                return "signed_chromosomes"
    return "ids_strands" if len(c) == 2 else "blocks"


def first_line(spark: SparkSession, path: str) -> str:
    """The first line that holds data, read by Spark, so from any store and codec that it reads."""
    row = data_lines(spark, path).orderBy("path", "line").select("value").first()
    return row.value if row else ""


def sniff_file(spark: SparkSession, path: str) -> str:
    return sniff(first_line(spark, path))


def mysql_lines(lines: Iterable[str]) -> Iterator[list[str | None]]:
    r"""Rows of a dump: a line that ends with a backslash goes on in the next; \N is null."""
    held = ""
    for line in lines:
        line = line.rstrip("\n")
        if line.endswith("\\"):
            held += line[:-1]
            continue
        yield [None if x == "\\N" else x for x in (held + line).split("\t")]
        held = ""


def typed_rows(lines: Iterable[str], types: Iterable, sep: str = "\t") -> Iterator[tuple]:
    """Rows with each column converted; (type, n) stands for n columns. A row of another width is an error."""
    kinds = [k for t in types for k in ([t[0]] * t[1] if isinstance(t, tuple) else [t])]
    for line in lines:
        cells = line.rstrip("\r\n").split(sep)
        if len(cells) != len(kinds):
            raise ValueError(f"{len(cells)} columns where {len(kinds)} are due: {line!r}")
        yield tuple(k(x) for k, x in zip(kinds, cells))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A TSV table without quotes, comments left out; a row that doesn't fit the schema is an error."""
    return spark.read.csv(path, schema=schema, sep="\t", quote="", comment="#", mode="FAILFAST")


def number_range(text: str) -> list[int]:
    """start:end (both in), or the numbers of a file."""
    if ":" in text and not os.path.exists(text):
        a, b = text.split(":")
        return list(range(int(a), int(b) + 1))
    with open_text(text) as f:
        return [int(x) for line in f for x in line.split()]


def cutoffs(text: str) -> float | dict[str, float]:
    """One number, or a file of ancestors with theirs."""
    try:
        return float(text)
    except ValueError:
        with open_text(text) as f:
            return {k: float(v) for k, v in (line.split("\t")[:2] for line in content_lines(f))}


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence (in upper case, without line ends)."""
    parts = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    name = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return parts.select(F.trim(name).alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")).alias("sequence"))


def ini(lines: Iterable[str]) -> dict[str, list[str]]:
    """Sections (`> name`) and their lines; comments and blank lines left out."""
    out: dict[str, list[str]] = {}
    section = ""
    for line in lines:
        line = line.split("#")[0].strip()
        if line.startswith(">"):
            section = line[1:].strip()
            out.setdefault(section, [])
        elif line:
            out.setdefault(section, []).append(line)
    return out
