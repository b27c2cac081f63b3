"""Reference sequences, their index, and interval files."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.reference import chunked

FAI = "contig string, length long, offset long, linebases int, linewidth int"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq): names up to the first space, sequences in upper case without line ends."""
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    name = F.regexp_extract("value", r"^([^\s]+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(name.alias("contig"), F.upper(body).alias("seq"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    return chunked(read_fasta(spark, path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index beside a FASTA file (``path`` is the FASTA's)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(f"{path}.fai", sep="\t", schema=FAI)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}.fai is missing; make it with: samtools faidx {path}") from e


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end) from 0, end exclusive. Three fields are an interval; two, or an end before the start, a position counted from 1; a
    lone name and comments are nothing. ``-`` is standard input."""
    lines = spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "value string") if path == "-" else spark.read.text(path)
    f = F.split(F.trim(F.col("value")), r"\s+")
    start, end = F.get(f, F.lit(1)).try_cast("int"), F.get(f, F.lit(2)).try_cast("int")
    rows = lines.where(~F.col("value").startswith("#")).select(F.get(f, F.lit(0)).alias("contig"), start.alias("a"), end.alias("b")).where("a IS NOT NULL")
    point = F.col("b").isNull() | (F.col("b") < F.col("a"))
    return rows.select("contig", F.when(point, F.col("a") - 1).otherwise(F.col("a")).alias("start"), F.when(point, F.col("a")).otherwise(F.col("b")).alias("end"))


def missing_contigs(contigs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contigs of the reads that the reference has, and those that it hasn't."""
    names = index.select("contig")
    return contigs.join(names, "contig", "left_semi"), contigs.join(names, "contig", "left_anti")
