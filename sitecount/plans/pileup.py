"""Counting: gates, filter and router, mate overlap, aggregation by site and strand, and the site filter.

Reads of one name meet once, as reads: a window over (contig, name) gives each its rank in file order and the stretch where another one may
cover the same positions. One generator unnests the reads. The first aggregate counts what lies outside of that stretch by position
and code, combined before the shuffle; only inside of it are bases keyed by name, too, and the best one is the largest of packed whole numbers
(mapping quality, first read, base quality, earliest read; below them what is counted), so that all stays one hash aggregate. Events (deletions,
skips, rejected reads) never compete. The second lays the codes out as columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compiler import Compiler, Steps, by_base, passes, slot, tag_names, uses_reference
from ..functions.language import parse
from ..schema import BASES, COUNTS, DEFAULT_EXCLUDED, EVENTS, SLOTS
from .bases import BASE, base_index, consumed, passes_flags, positions, query_length, read_scope, reference_length, strand
from .reference import with_reference
from .regions import overlapping, reads_touching, within

_ORD = (1 << 32) - 1
CODE_BITS = 7


@dataclass(frozen=True)
class Config:
    """What to count. ``strand`` is both, forward or reverse; ``region`` is (contig, start, end) from 0; ``dedup`` turns mate overlap off."""

    required: int = 0
    excluded: int = DEFAULT_EXCLUDED
    strand: str = "both"
    region: tuple[str, int, int] | None = None
    read_filter: str | None = None
    site_filter: str | None = None
    max_depth: int = 0
    dedup: bool = True
    motif_pad: int = 0


def gated(reads: DataFrame, config: Config) -> DataFrame:
    """Reads with their strand ``s`` and whether they pass the flag gates, ``ok``; reads off the wanted strand and region are gone."""
    out = reads_touching(reads, config.region, reference_length(F.col("cigar"))).where("tid >= 0 AND pos >= 0")
    out = out.withColumn("s", strand(F.col("flag"))).withColumn("ok", passes_flags(F.col("flag"), config.required, config.excluded))
    if config.strand != "both":
        out = out.where(F.col("s") == (0 if config.strand == "forward" else 1))
    return out


def _guards(node: tuple) -> list[tuple]:
    """Left operands of a chain of ``and`` that is a router's whole expression, but the last."""
    if node[0] == "bin" and node[1] == "and":
        return [*_guards(node[2]), node[2]] if node[2][0] == "bin" and node[2][1] == "and" else [node[2]]
    return []


def routed(reads: DataFrame, reference: DataFrame | None, config: Config) -> DataFrame:
    """Positions with ``slot``; bases that the read filter drops are gone, or have none. What only depends on the read is evaluated once for it.

    Dropped bases aren't filtered out here: Spark would push that filter down through all steps of the expression and evaluate them twice.
    """
    if config.read_filter is None:
        return _capped(positions(reads), config).withColumn("slot", F.when(F.col("kind") == BASE, 0))
    tree = parse(config.read_filter)
    named = {t: f"_tag_{t}" for t in tag_names(tree) if len(t) == 2}
    tags = lambda t: F.col(named[t])
    reads = reads.withColumns({c: F.try_element_at("tags", F.lit(t)) for t, c in named.items()})
    steps = Steps()
    compiler = Compiler(read_scope(), tags, steps)
    value = compiler.compile(tree)
    guard = None
    for g in _guards(tree):
        if not by_base(g):
            test = passes(compiler.compile(g))
            guard = test if guard is None else guard & test
    reads = steps.of_reads(reads)
    if not by_base(tree):
        out = _capped(positions(reads.withColumn("_slot", slot(value))), config)
        return out.where((F.col("kind") != BASE) | F.col("_slot").isNotNull()).withColumn("slot", F.when(F.col("kind") == BASE, F.col("_slot"))).drop("_slot")
    if guard is not None:
        reads = reads.withColumn("_guard", guard)
    out = _capped(positions(reads, reference if uses_reference(tree) else None), config)
    if guard is not None:
        out = out.where((F.col("kind") != BASE) | F.col("_guard")).drop("_guard")
    return steps.of_bases(out).withColumn("slot", F.when(F.col("kind") == BASE, slot(value)))


def _capped(rows: DataFrame, config: Config) -> DataFrame:
    """The first ``max_depth`` reads in file order at each position."""
    rows = rows.where(within(config.region, F.col("rpos")))
    if not config.max_depth:
        return rows
    place = F.row_number().over(Window.partitionBy("tid", "rpos").orderBy("ord"))
    return rows.withColumn("_place", place).where(F.col("_place") <= config.max_depth).drop("_place", "home")


def may_count(reads: DataFrame, config: Config) -> DataFrame:
    """Reads that may be among the first ``max_depth`` at a position: of those that cover the very same positions, the first ones in file order. The others have that many before them everywhere.

    Reads whose sequence ends early leave out positions and all stay.
    """
    if not config.max_depth:
        return reads
    end = F.col("pos") + reference_length(F.col("cigar"))
    early = F.when(F.col("ok") & (query_length(F.col("seq")) < consumed(F.col("cigar"))), F.col("ord"))
    same = reads.withColumns({"_end": end, "_early": early})
    place = F.row_number().over(Window.partitionBy("tid", "pos", "_end", "_early").orderBy("ord"))
    return same.withColumn("_place", place).where(F.col("_place") <= config.max_depth).drop("_place", "_end", "_early")


def with_rivals(reads: DataFrame, parts: int | None = None) -> DataFrame:
    """Reads with ``rank``, their place in file order among those of their name and contig, and the stretch ``[rival_from, rival_to)`` outside of which no other of these has a base.

    Two reads tell each other's stretch; of three and more, each takes its own as a whole. ``parts`` says by how many tasks they are unnested, each of which is the ``home``
    of its names: what is counted by name then stays there, as long as nothing else spreads the rows. Else Spark says by how many.
    """
    names = ["tid", "qname", "ok"]
    if parts is not None:
        reads = reads.withColumn("home", F.pmod(F.hash(*names), F.lit(parts))).repartitionById(parts, "home")
        names = ["home", *names]
    name = Window.partitionBy(*names).orderBy("ord")
    every = name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = reads.withColumn("_end", F.col("pos") + reference_length(F.col("cigar")))
    out = out.withColumns({"rank": F.row_number().over(name), "_n": F.count(F.lit(1)).over(every), "_pos": F.sum("pos").over(every), "_ends": F.sum("_end").over(every)})
    low = F.when(F.col("_n") == 2, F.col("_pos") - F.col("pos")).otherwise(F.col("pos"))
    high = F.when(F.col("_n") == 1, F.col("pos")).when(F.col("_n") == 2, F.col("_ends") - F.col("_end")).otherwise(F.col("_end"))
    return out.withColumns({"rival_from": low.cast("int"), "rival_to": high.cast("int")}).drop("_end", "_n", "_pos", "_ends")


def _code() -> Column:
    """What is counted: group, base and strand, or an event and its strand."""
    return F.when(F.col("kind") == BASE, F.col("slot") * 16 + base_index(F.col("letter")) * 2 + F.col("s")).otherwise(64 + (F.col("kind") - 1) * 2 + F.col("s"))


def packed(code: Column) -> Column:
    """The number whose maximum is the best base of a read name at a position; its low bits, ``code``, say what is counted."""
    long = lambda c: c.cast("bigint")
    first = F.when(F.col("flag").bitwiseAND(64) != 0, 1).otherwise(0)
    best = F.shiftleft(long(F.col("mapq")), 49).bitwiseOR(F.shiftleft(long(first), 48)).bitwiseOR(F.shiftleft(long(F.col("bq") + 1), 39))
    return best.bitwiseOR(F.shiftleft(F.lit(_ORD) - long(F.col("rank")), CODE_BITS)).bitwiseOR(long(code))


def best_by_name(rows: DataFrame, code: Column, best: Column, bits: int) -> DataFrame:
    """(tid, contig, rpos, code, n): how often a code wins at a position. Bases of one name compete by ``best``, a whole number whose low ``bits`` are the code; events don't.
    Rows of a position and code aren't summed up yet; those without a code are left out, after they have met in one row of their position. Rows with a ``home`` aren't shuffled:
    all bases of a name are in one part, and a task holds no more than its reads give."""
    place = ["tid", "contig", "rpos"]
    home = ["home"] if "home" in rows.columns else []
    rows = rows.withColumn("_rival", (F.col("kind") == BASE) & code.isNotNull() & (F.col("rpos") >= F.col("rival_from")) & (F.col("rpos") < F.col("rival_to")))
    rival = F.col("_rival")
    keyed = rows.select(*home, *place, F.when(rival, F.col("qname")).alias("name"), F.when(~rival, code).alias("code"), F.when(rival, best).alias("p"))
    won = keyed.groupBy(*home, *place, "name", "code").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    own = F.col("p").bitwiseAND((1 << bits) - 1).cast("int")
    return won.select(*place, F.coalesce("code", own).alias("code"), F.when(F.col("p").isNull(), F.col("n")).otherwise(1).cast("long").alias("n")).where("code IS NOT NULL")


def winners(rows: DataFrame, dedup: bool = True) -> DataFrame:
    """(tid, contig, rpos, code, n) of routed rows, whose reads have rivals if ``dedup`` is set."""
    rows = rows.withColumn("_code", _code())
    code = F.col("_code")
    if dedup:
        return best_by_name(rows, code, packed(code), CODE_BITS)
    return rows.groupBy("tid", "contig", "rpos", code.alias("code")).agg(F.count(code).alias("n")).where("n > 0")


def sites(reads: DataFrame, reference: DataFrame | None, config: Config, parts: int | None = None) -> DataFrame:
    """(tid, contig, pos, s, 20 counts by base and group, del, ref_skip, fail), a row for each position and strand with anything to count."""
    own = may_count(gated(reads, config), config)
    rows = routed(with_rivals(own, parts) if config.dedup else own, reference, config)
    counted = winners(rows, config.dedup)
    is_base, kind = F.col("code") < 64, F.shiftright(F.col("code"), 1)
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    columns = [total(is_base & (F.col("code").bitwiseAND(62) == g * 16 + b * 2)).alias(f"{BASES[b].lower()}{g}") for b in range(5) for g in range(SLOTS)]
    columns += [total(~is_base & (kind == 32 + k)).alias(e) for k, e in enumerate(EVENTS)]
    return counted.groupBy("tid", "contig", F.col("rpos").cast("long").alias("pos"), F.col("code").bitwiseAND(1).alias("s")).agg(*columns)


def total(letter: str) -> Column:
    """A base's count over all groups."""
    return sum((F.col(f"{letter.lower()}{k}") for k in range(1, SLOTS)), F.col(f"{letter.lower()}0"))


def depth() -> Column:
    return sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))


def site_scope(strandless: bool = False, motif: bool = False) -> dict[str, tuple[str, Column]]:
    """The variables of site expressions and templates, over ``sites`` with ``ref``."""
    letter = F.col("ref")
    local = F.when(letter.isin("A", "T"), "A").otherwise(letter) if strandless else F.when(F.col("s") == 1, F.translate(letter, "ACGT", "TGCA")).otherwise(letter)
    one: dict[str, tuple[str, Column]] = {
        "pos POS": ("int", F.col("pos")),
        "ref ref_base REF": ("str", letter),
        "base BASE": ("str", local),
        "depth DEPTH": ("int", depth()),
        "chrom": ("str", F.col("contig")),
        "ins": ("int", F.lit(0).cast("bigint")),
    }
    one |= {f"{b.lower()} {b}": ("int", total(b)) for b in BASES}
    one |= {c: ("int", F.col(c)) for c in [*COUNTS, *EVENTS]}
    if motif:
        one["motif"] = ("str", F.col("motif"))
    if not strandless:
        one["strand"] = ("str", F.when(F.col("s") == 1, "-").otherwise("+"))
        one["strand_code"] = ("int", (1 - 2 * F.col("s")).cast("bigint"))
    return {name: v for group, v in one.items() for name in group.split()}


def site_table(reads: DataFrame, reference: DataFrame, config: Config, include: DataFrame | None = None, exclude: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Sites that pass: with ``ref`` (and ``motif``, forward), on known positions of known contigs, inside and outside of interval sets, by the site filter of each strand."""
    out = sites(reads, reference, config, parts)
    if include is not None:
        out = overlapping(out, include)
    if exclude is not None:
        out = overlapping(out, exclude, keep=False)
    out = with_reference(out, reference, "pos", config.motif_pad)
    if config.site_filter is not None:
        out = out.where(passes(Compiler(site_scope(motif=True)).compile(parse(config.site_filter))))
    return out
