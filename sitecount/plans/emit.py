"""Output forms of site tables: composition, with or without strands and events, best alternate alleles, and rows by template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.template import compile_template
from ..schema import BASES, COUNTS, EVENTS
from .bases import reverse_complement
from .pileup import depth, site_scope, total

_ROW = ["pos", "ref", "depth", "a", "c", "g", "t", "n"]
VCF_HEADER = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]


def _counts() -> list[Column]:
    return [total(b).alias(b.lower()) for b in BASES]


def _something() -> Column:
    return depth() + F.col("del") + F.col("ref_skip") + F.col("fail") > 0


def composition(sites: DataFrame, events: bool = False) -> DataFrame:
    """A row for each strand of a site: tid, chrom, pos (from 1), strand, ref, depth, a, c, g, t, n, and events."""
    extra = [F.lit(0).cast("long").alias("ins"), *EVENTS] if events else []
    return sites.where(_something()).select("tid", F.col("contig").alias("chrom"), (F.col("pos") + 1).alias("pos"), F.when(F.col("s") == 1, "-").otherwise("+").alias("strand"), "ref", depth().alias("depth"), *_counts(), *extra)


def collapsed(sites: DataFrame) -> DataFrame:
    """Both strands of a site in one row (``s`` is null); of the strands that passed."""
    return sites.groupBy("tid", "contig", "pos", "ref", "motif").agg(*[F.sum(c).alias(c) for c in [*COUNTS, *EVENTS]]).withColumn("s", F.lit(None).cast("int"))


def strandless(sites: DataFrame, events: bool = False) -> DataFrame:
    return composition(collapsed(sites), events).drop("strand")


def with_alternate(sites: DataFrame) -> DataFrame:
    """Collapsed sites with ref_count, alt and alt_count: the most frequent letter but the reference's, the first in order among equals; ``.`` and 0 for none."""
    one = collapsed(sites)
    other = {b: F.when(F.col("ref") == b, F.lit(0)).otherwise(total(b)) for b in "ACGT"}
    most = F.greatest(*other.values())
    alt = F.lit(".")
    for b in "TGCA":
        alt = F.when(other[b] == most, F.lit(b)).otherwise(alt)
    own = F.lit(0).cast("long")
    for b in "ACGT":
        own = F.when(F.col("ref") == b, total(b)).otherwise(own)
    return one.select("*", own.cast("long").alias("ref_count"), F.when(most > 0, alt).otherwise(".").alias("alt"), most.cast("long").alias("alt_count"), depth().alias("depth"))


def alleles(sites: DataFrame) -> DataFrame:
    """tid, chrom, pos, ref, depth, ref_count, alt, alt_count of sites with any base."""
    return with_alternate(sites).where("depth > 0").select("tid", F.col("contig").alias("chrom"), (F.col("pos") + 1).alias("pos"), "ref", "depth", "ref_count", "alt", "alt_count")


def vcf(sites: DataFrame) -> DataFrame:
    """Lines of variants: tid, pos and line."""
    rows = alleles(sites).where("alt_count > 0")
    dot = F.lit(".")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot, "ref", "alt", dot, F.lit("PASS"), dot, F.lit("GT:AD"), F.concat(F.lit("0/1:"), "ref_count", F.lit(","), "alt_count"))
    return rows.select("tid", "pos", line.alias("line"))


def by_template(sites: DataFrame, template: str, no_strand: bool = False, target_base: str | None = None) -> DataFrame:
    """tid, pos, s and line; rows whose template fails are gone. The motif of a minus row is reverse-complemented."""
    rows = collapsed(sites) if no_strand else sites
    rows = rows.where(_something())
    if not no_strand:
        rows = rows.withColumn("motif", F.when(F.col("s") == 1, reverse_complement(F.regexp_replace("motif", "[^ACGT]", "N"))).otherwise(F.col("motif")))
    scope = site_scope(no_strand, motif=True)
    if target_base and not no_strand:
        rows = rows.where(scope["base"][1] == target_base.upper())
    line, failed = compile_template(template, scope)
    return rows.where(~failed).select("tid", "pos", "s", line.alias("line"))


def in_order(rows: DataFrame) -> DataFrame:
    """By contig order, position and strand, plus before minus."""
    keys = [k for k in ("tid", "pos", "s", "strand") if k in rows.columns]
    return rows.orderBy(*[F.col(k).asc() if k != "strand" else (F.col(k) == "-").asc() for k in keys])


def lines(rows: DataFrame) -> DataFrame:
    """One text column, tab-separated, in order."""
    ordered = in_order(rows)
    shown = [c for c in rows.columns if c != "tid"]
    return ordered.select("line") if "line" in rows.columns else ordered.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in shown]).alias("line"))


def header(rows: DataFrame) -> str:
    return "\t".join(c for c in rows.columns if c != "tid")
