"""Regions and interval sets: predicates on positions, and range joins by bins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RegionError

#: Bits of a bin of positions.
BIN = 13


def parse_region(text: str) -> tuple[str, int, int]:
    """``contig:start-end``, counted from 1 and inclusive, as (contig, start, end) counted from 0, end exclusive. Without an end the region is empty."""
    contig, colon, span = text.rpartition(":")
    m = re.fullmatch(r"([0-9,]+)(?:-([0-9,]*))?", span.strip())
    if not colon or not contig or not m:
        raise RegionError(f"not a region: {text!r}")
    number = lambda s: int(s.replace(",", "")) if s and s.strip(",") else 0
    return contig, max(0, number(m.group(1)) - 1), number(m.group(2))


def within(region: tuple[str, int, int] | None, pos: Column) -> Column:
    if region is None:
        return F.lit(True)
    contig, start, end = region
    return (F.col("contig") == contig) & (pos >= start) & (pos < end)


def reads_touching(reads: DataFrame, region: tuple[str, int, int] | None, length: Column) -> DataFrame:
    """Reads that may cover a position of the region."""
    if region is None:
        return reads
    contig, start, end = region
    return reads.where((F.col("contig") == contig) & (F.col("pos") < end)).where(F.col("pos") + length > start)


def binned(intervals: DataFrame) -> DataFrame:
    """Intervals (contig, start, end), one row for each bin that they touch."""
    good = intervals.where("end > start")
    low, high = F.shiftright("start", BIN), F.shiftright(F.col("end") - 1, BIN)
    return good.select(F.col("contig").alias("i_contig"), F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.explode(F.sequence(low, high)).alias("i_bin"))


def overlapping(sites: DataFrame, intervals: DataFrame, keep: bool = True) -> DataFrame:
    """Sites (contig, pos) in some interval, or in none: an equi-join on contig and bin with the bounds as the rest of the condition."""
    parts = binned(intervals)
    on = (F.col("contig") == F.col("i_contig")) & (F.shiftright(F.col("pos").cast("int"), BIN) == F.col("i_bin")) & (F.col("pos") >= F.col("i_start")) & (F.col("pos") < F.col("i_end"))
    return sites.join(parts, on, "left_semi" if keep else "left_anti")
