"""Conversion tiers: counts of unconverted and converted bases at the positions of one reference letter, by conversion quality of their reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bases import BASE, base_index, complement, positions, query_length, reverse_complement, strand
from ..plans.pileup import best_by_name, depth, total, with_rivals
from ..plans.reference import with_reference

#: Bits of what is counted; ranks in file order of reads of one name stay below ``LAST``.
CODE_BITS, LAST = 4, (1 << 32) - 1


@dataclass(frozen=True)
class Tiers:
    """Letters, trims in the molecule's direction, and limits of the tags NS (substitutions), Zf (unconverted) and Yf (converted)."""

    ref_base: str = "A"
    mut_base: str = "G"
    trim_start: int = 2
    trim_end: int = 2
    max_unc: int = 3
    min_con: int = 1
    max_sub: int = 1
    min_baseq: int = 20
    min_mapq: int = 0
    pad: int = 15
    strand: str = "both"


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))["i"]


def reasons(config: Tiers) -> list[tuple[str, Column]]:
    """Why a read is skipped, in the order of the tests; nulls don't match."""
    flag = F.col("flag")
    side = F.lit(False) if config.strand == "both" else F.col("s") != (0 if config.strand == "forward" else 1)
    return [
        ("wrong_strand", side),
        ("unmapped", flag.bitwiseAND(4) != 0),
        ("duplicate", flag.bitwiseAND(1024) != 0),
        ("secondary", flag.bitwiseAND(256) != 0),
        ("low_mapq", F.col("mapq") < config.min_mapq),
        ("missing_tags", _tag("NS").isNull() | ((_tag("NS") <= config.max_sub) & (_tag("Zf").isNull() | _tag("Yf").isNull()))),
        ("mismatches", _tag("NS") > config.max_sub),
        ("conversion", ~((_tag("Zf") <= config.max_unc) & (_tag("Yf") >= config.min_con))),
        ("no_sequence", query_length(F.col("seq")) == 0),
    ]


def skip_reason(config: Tiers) -> Column:
    out = F.lit(None).cast("string")
    for name, test in reversed(reasons(config)):
        out = F.when(test, name).otherwise(out)
    return out


def skip_counters(reads: DataFrame, config: Tiers = Tiers()) -> DataFrame:
    """One row: reads, used ones, and skipped ones by reason, in one pass."""
    df = reads.withColumn("s", strand(F.col("flag"))).select(skip_reason(config).alias("why"))
    each = [F.count(F.when(F.col("why") == name, 1)).alias(name) for name, _ in reasons(config)]
    return df.agg(F.count(F.lit(1)).alias("total_reads"), F.count(F.when(F.col("why").isNull(), 1)).alias("used"), *each)


def observations(reads: DataFrame, config: Tiers, parts: int | None = None) -> DataFrame:
    """The best base, by quality, then file order, of each read name at each position: tid, contig, pos, s, base (in the molecule's letters) and n, how many.
    Trimmed bases and those of low quality don't compete."""
    df = with_rivals(reads.withColumn("s", strand(F.col("flag"))).where(skip_reason(config).isNull()).withColumn("ok", F.lit(True)), parts)
    rows = positions(df).where(F.col("kind") == BASE)
    left, right = F.when(F.col("s") == 1, config.trim_end).otherwise(config.trim_start), F.when(F.col("s") == 1, config.trim_start).otherwise(config.trim_end)
    rows = rows.where((F.col("qpos") >= left) & (F.col("qlen") - F.col("qpos") > right)).withColumn("bq", F.greatest("bq", F.lit(0))).where(F.col("bq") >= config.min_baseq)
    code = base_index(F.col("letter")) * 2 + F.col("s")
    order = F.shiftleft(F.col("bq").cast("bigint"), 40).bitwiseOR(F.shiftleft(F.lit(LAST) - F.col("rank").cast("bigint"), CODE_BITS)).bitwiseOR(code.cast("bigint"))
    best = best_by_name(rows, code, order, CODE_BITS)
    letter = F.substring(F.lit("ACGTN"), F.shiftright("code", 1) + 1, F.lit(1))
    s = F.col("code").bitwiseAND(1)
    return best.select("tid", "contig", F.col("rpos").cast("long").alias("pos"), s.alias("s"), F.when(s == 1, complement(letter)).otherwise(letter).alias("base"), "n")


def tiers(reads: DataFrame, reference: DataFrame, config: Tiers = Tiers(), parts: int | None = None) -> DataFrame:
    """chrom, pos (from 1), strand, motif, u0..u2, m0..m2, o0..o2 and mutation_rate, at positions whose reference letter is ``ref_base``, on either strand.
    All that is counted is of tier 1: bases of low quality and badly converted reads are gone before."""
    kind = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    base = F.col("base")
    zero = F.lit(0).cast("long")
    grouped = observations(reads, config, parts).groupBy("tid", "contig", "pos", "s").agg(kind(base == config.ref_base).alias("u1"), kind(base == config.mut_base).alias("m1"), kind(~base.isin(config.ref_base, config.mut_base)).alias("o1"))
    sited = with_reference(grouped.where("u1 + m1 > 0"), reference, "pos", config.pad).where(F.col("ref") == config.ref_base)
    motif = F.when(F.col("s") == 1, reverse_complement(F.col("motif"))).otherwise(F.col("motif"))
    return sited.select(
        F.col("contig").alias("chrom"), (F.col("pos") + 1).alias("pos"), F.when(F.col("s") == 1, "-").otherwise("+").alias("strand"), motif.alias("motif"),
        zero.alias("u0"), "u1", zero.alias("u2"), zero.alias("m0"), "m1", zero.alias("m2"), zero.alias("o0"), "o1", zero.alias("o2"), (F.col("m1") / (F.col("u1") + F.col("m1"))).alias("mutation_rate"),
    )


def headers(save_rest: bool = False) -> list[str]:
    """The columns of a written table."""
    rest = ["o0", "o1", "o2"] if save_rest else []
    return ["chrom", "pos", "strand", "motif", "u0", "u1", "u2", "m0", "m1", "m2", *rest, "mutation_rate"]


def mutation_rate(sites: DataFrame, ref_base: str, mut_base: str) -> DataFrame:
    """u, m and o in the strand's letters at its ``ref_base`` positions, and m / (u + m), null where both are 0."""
    def local(letter: str) -> Column:
        other = {"A": "T", "C": "G", "G": "C", "T": "A"}[letter]
        return F.when(F.col("s") == 1, total(other)).otherwise(total(letter))

    u, m = local(ref_base), local(mut_base)
    here = F.when(F.col("s") == 1, complement(F.col("ref"))).otherwise(F.col("ref")) == ref_base
    rows = sites.where(here).select(F.col("contig").alias("chrom"), (F.col("pos") + 1).alias("pos"), F.when(F.col("s") == 1, "-").otherwise("+").alias("strand"), u.alias("u"), m.alias("m"), (depth() - u - m).alias("o"))
    return rows.withColumn("mutation_rate", F.when(F.col("u") + F.col("m") > 0, F.col("m") / (F.col("u") + F.col("m"))))
