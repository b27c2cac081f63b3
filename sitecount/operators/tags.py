"""Counts of a second conversion in each read, written as the tags Yc and Zc, and adjusted mismatch counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bases import BASE, complement, positions, reference_length, strand
from ..plans.regions import reads_touching


def _aligned(reads: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    rows = positions(reads.withColumn("s", strand(F.col("flag"))).withColumn("ok", F.lit(True)), reference).where(F.col("kind") == BASE)
    letter = F.when(F.col("letter").isin("A", "C", "G", "T"), F.col("letter")).otherwise("N")
    return rows.withColumn("letter", F.when(F.col("s") == 1, complement(letter)).otherwise(letter))


def alternative_counts(reads: DataFrame, reference: DataFrame, ref_base: str, mut_base: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """(ord, alt_ref, alt_mut) by read: bases at positions whose letter, in the molecule's direction, is ``ref_base``, that keep it or are ``mut_base``. Reads without any are left out."""
    if region is not None:
        reads = reads_touching(reads, region, reference_length(F.col("cigar")))
    rows = _aligned(reads, reference)
    if region is not None:
        rows = rows.where((F.col("contig") == region[0]) & (F.col("rpos") >= region[1]) & (F.col("rpos") < region[2]))
    rows = rows.where(F.when(F.col("s") == 1, complement(F.col("ref"))).otherwise(F.col("ref")) == ref_base)
    return _by_read(rows, ref_base, mut_base)


def alternative_counts_by_base(reads: DataFrame, ref_base: str, mut_base: str, min_baseq: int = 20, trim_start: int = 2, trim_end: int = 2) -> DataFrame:
    """The same without a reference: trimmed bases of good quality that are either letter."""
    rows = _aligned(reads)
    left, right = F.when(F.col("s") == 1, trim_end).otherwise(trim_start), F.when(F.col("s") == 1, trim_start).otherwise(trim_end)
    good = F.greatest("bq", F.lit(0)) >= min_baseq
    return _by_read(rows.where((F.col("qpos") >= left) & (F.col("qlen") - F.col("qpos") > right) & good), ref_base, mut_base)


def _by_read(rows: DataFrame, ref_base: str, mut_base: str) -> DataFrame:
    count = lambda x: F.count(F.when(F.col("letter") == x, 1))
    return rows.where(F.col("letter").isin(ref_base, mut_base)).groupBy("ord").agg(count(ref_base).alias("alt_ref"), count(mut_base).alias("alt_mut"))


def _number(value: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("i").alias("t"), value.cast("long").alias("i"), none.cast("double").alias("f"), none.cast("string").alias("s"))


def _set(tags: Column, values: dict[str, Column]) -> Column:
    """The map with some entries set or replaced."""
    kept = F.map_filter(tags, lambda k, _: ~k.isin(*values))
    return F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), _number(v))]))


def tagged(reads: DataFrame, counts: DataFrame, swapped: bool = False) -> DataFrame:
    """Reads with the tags Yc, the changed bases, and Zc, the kept ones; with ``swapped`` the other way round, as the variant without a reference writes
    them. NS, if there, loses the changed bases, and never falls below 0."""
    both = reads.join(counts, "ord", "left").fillna(0, ["alt_ref", "alt_mut"])
    mut, ref = (F.col("alt_ref"), F.col("alt_mut")) if swapped else (F.col("alt_mut"), F.col("alt_ref"))
    own = _set(F.col("tags"), {"Yc": mut, "Zc": ref})
    ns = F.try_element_at("tags", F.lit("NS"))["i"]
    own = F.when(ns.isNotNull(), _set(own, {"NS": F.greatest(ns - F.col("alt_mut"), F.lit(0))})).otherwise(own)
    return both.withColumn("tags", own).select(*reads.columns)


def tag_stats(reads: DataFrame) -> DataFrame:
    """One row over tagged reads: how many there are, have either tag, their sums, and reads with either above 0."""
    yc, zc = (F.try_element_at("tags", F.lit(t))["i"] for t in ("Yc", "Zc"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    some = (F.coalesce(yc, F.lit(0)) > 0) | (F.coalesce(zc, F.lit(0)) > 0)
    return reads.agg(F.count(F.lit(1)).alias("total_reads"), F.count(yc).alias("reads_with_yc"), F.count(zc).alias("reads_with_zc"), total(yc).alias("total_yc"), total(zc).alias("total_zc"), F.count(F.when(some, 1)).alias("reads_with_alternatives"))


def sam_lines(reads: DataFrame) -> DataFrame:
    """Reads as SAM lines in contig and position order, without a header."""
    text = lambda k, v: F.concat(k, F.when(v["t"] == "i", F.concat(F.lit(":i:"), v["i"].cast("string"))).when(v["t"] == "f", F.concat(F.lit(":f:"), v["f"].cast("string"))).otherwise(F.concat(F.when(v["t"] == "B", ":B:").otherwise(":Z:"), v["s"])))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: text(e["key"], e["value"]))
    cigar = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), F.substring(F.lit("MIDNSHP=X"), x["op"] + 1, F.lit(1)))), "")
    qual = F.array_join(F.transform("qual", lambda q: F.call_function("chr", q + 33)), "")
    some = lambda c, d: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(d)
    fields = ["qname", F.col("flag").cast("string"), some(F.col("contig"), "*"), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), some(cigar, "*"), some(F.col("mcontig"), "*"), (F.col("mpos") + 1).cast("string"), F.col("tlen").cast("string"), "seq", some(qual, "*"), some(F.array_join(tags, "\t"), None)]
    return reads.orderBy("tid", "pos", "ord").select(F.concat_ws("\t", *fields).alias("value"))
