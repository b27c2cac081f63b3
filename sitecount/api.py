"""Counting from files: readers, plan, output, and a summary."""

from __future__ import annotations

import gzip
import os
import sys
import time
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.language import parse, unescape
from .functions.template import pieces
from .operators.legacy import Tiers, headers, tiers
from .operators.tags import alternative_counts, alternative_counts_by_base, sam_lines, tagged
from .plans import emit
from .plans.pileup import Config, site_table
from .plans.regions import parse_region
from .schema import InputError, RegionError
from .sources.bam import read_bam
from .sources.bam_writer import header_text, write_bam
from .sources.fasta import read_intervals, read_reference
from .sources.sam import read_sam


@dataclass(frozen=True)
class Output:
    """The form of the output: composition, with ``strandless`` and ``events``; ``vcf``; ``alleles``; or a ``template`` with its ``header``."""

    strandless: bool = False
    events: bool = False
    vcf: bool = False
    alleles: bool = False
    template: str | None = None
    header: str | None = None
    target_base: str | None = None


def open_reads(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads and contigs of a BAM or SAM file, told apart by the first bytes, elsewhere by the name. A region may leave out reads that don't touch it."""
    local = path.removeprefix("file://")
    if "://" in local:
        return read_bam(spark, path, region=region) if path.endswith(".bam") else read_sam(spark, path)
    if not os.path.exists(local):
        raise InputError(f"{path}: no such file")
    with open(local, "rb") as f:
        head = f.read(4)
    if head == b"CRAM":
        raise InputError(f"{path} is CRAM, which isn't read; convert it with: samtools view -b")
    if head[:2] == b"\x1f\x8b":
        with gzip.open(local) as f:
            if f.read(4) == b"BAM\1":
                return read_bam(spark, local, region=region)
    return read_sam(spark, path)


def count_sites(spark: SparkSession, reads: str, reference: str, config: Config = Config(), include: str | None = None, exclude: str | None = None) -> DataFrame:
    """The table of sites that pass."""
    if config.read_filter:
        parse(config.read_filter)
    if config.site_filter:
        parse(config.site_filter)
    rows, contigs = open_reads(spark, reads, config.region)
    if config.region is not None and contigs.where(F.col("contig") == config.region[0]).isEmpty():
        raise RegionError(f"unknown contig {config.region[0]!r}")
    sets = {k: read_intervals(spark, v) for k, v in (("include", include), ("exclude", exclude)) if v}
    return site_table(rows, read_reference(spark, reference), config, **sets)


def formatted(sites: DataFrame, output: Output) -> tuple[DataFrame, list[str]]:
    """Rows of the output form, and its header lines."""
    if output.template is not None:
        pieces(output.template)
        head = [unescape(output.header)] if output.header else []
        return emit.by_template(sites, output.template, output.strandless, output.target_base), head
    if output.vcf:
        return emit.vcf(sites), emit.VCF_HEADER
    rows = emit.alleles(sites) if output.alleles else (emit.strandless if output.strandless else emit.composition)(sites, output.events)
    return rows, [emit.header(rows)]


def write_lines(rows: DataFrame, head: list[str], path: str | None, ordered: bool = False) -> int:
    """Stream the ordered rows to one file, or standard output; the driver holds one partition at a time. Returns how many rows were written."""
    out = open(path, "w", encoding="utf-8") if path else sys.stdout  # noqa: SIM115
    n = 0
    try:
        for line in head:
            print(line, file=out)
        for row in (rows if ordered else emit.lines(rows)).toLocalIterator(prefetchPartitions=True):
            print(row.line, file=out)
            n += 1
    finally:
        if path:
            out.close()
    return n


def run(spark: SparkSession, reads: str, reference: str, out: str | None = None, config: Config = Config(), output: Output = Output(), region: str | None = None, include: str | None = None, exclude: str | None = None) -> dict:
    """Count a file and write the rows in contig, position and strand order. Returns a summary: rows, seconds and the output's path."""
    began = time.time()
    if region:
        config = replace(config, region=parse_region(region))
    if not Path(reference.removeprefix("file://")).exists() and "://" not in reference.removeprefix("file://"):
        raise InputError(f"{reference}: no such file")
    rows, head = formatted(count_sites(spark, reads, reference, config, include, exclude), output)
    return {"rows": write_lines(rows, head, out), "seconds": time.time() - began, "output": out}


def run_tiers(spark: SparkSession, reads: str, reference: str, out: str | None = None, config: Tiers = Tiers(), save_rest: bool = False, region: str | None = None) -> dict:
    """Conversion tiers of a file, by contig name and position, with a header."""
    began = time.time()
    rows = tiers(open_reads(spark, reads)[0], read_reference(spark, reference), config)
    if region:
        contig, start, end = parse_region(region)
        rows = rows.where((F.col("chrom") == contig) & (F.col("pos") > start) & (F.col("pos") <= end))
    shown = headers(save_rest)
    ordered = rows.orderBy("chrom", "pos", F.col("strand") == "-").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in shown]).alias("line"))
    return {"rows": write_lines(ordered, ["\t".join(shown)], out, ordered=True), "seconds": time.time() - began, "output": out}


def tag_reads(spark: SparkSession, reads: str, out: str, ref_base: str, mut_base: str, reference: str | None = None, region: str | None = None) -> DataFrame:
    """Write the reads with the tags Yc and Zc: counted at the reference's letters, or without a reference by the bases alone. Returns the tagged reads.

    ``out`` is a sorted and indexed file if it ends with .bam, a file with a header if it ends with .sam, else a folder of SAM lines.
    """
    rows, contigs = open_reads(spark, reads)
    if reference is None:
        counts, swapped = alternative_counts_by_base(rows, ref_base, mut_base), True
    else:
        counts, swapped = alternative_counts(rows, read_reference(spark, reference), ref_base, mut_base, parse_region(region) if region else None), False
    got = tagged(rows, counts, swapped)
    if out.endswith(".bam"):
        write_bam(got, contigs, out)
    elif out.endswith(".sam"):
        head = header_text([(r.contig, r.length) for r in contigs.orderBy("tid").collect()])
        write_lines(sam_lines(got).withColumnRenamed("value", "line"), head, out, ordered=True)
    else:
        sam_lines(got).write.text(out)
    return got


def write_parts(rows: DataFrame, path: str) -> None:
    """The same rows as a folder of text files in order, for results that no single writer should pass."""
    keys = [k for k in ("tid", "pos", "s", "strand") if k in rows.columns]
    shown = [c for c in rows.columns if c != "tid"]
    line = F.col("line") if "line" in rows.columns else F.concat_ws("\t", *[F.col(c).cast("string") for c in shown])
    rows.repartitionByRange(*keys[:2]).sortWithinPartitions(*[F.col(k) if k != "strand" else F.col(k) == "-" for k in keys]).select(line.alias("value")).write.text(path)


def format_duration(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.2f}s"
    hours, rest = divmod(int(seconds), 3600)
    return (f"{hours}h " if hours else "") + f"{rest // 60}m {rest % 60}s"
