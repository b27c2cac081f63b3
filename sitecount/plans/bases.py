"""Unnesting of reads into positions: one generator for aligned bases, deletions, skipped reference and positions of rejected reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FLAGS
from .reference import CHUNK, MARGIN

CONSUMES_BOTH, DELETION, SKIP = (0, 7, 8), 2, 3
#: Kinds of position.
BASE, DEL, REF_SKIP, FAIL = 0, 1, 2, 3


def strand(flag: Column) -> Column:
    """0 for plus, 1 for minus, of the molecule: the second read of a pair counts the other way round."""
    reverse = flag.bitwiseAND(FLAGS["reverse"]) != 0
    second = (flag.bitwiseAND(FLAGS["paired"]) != 0) & (flag.bitwiseAND(FLAGS["read1"]) == 0)
    return F.when(reverse != second, 1).otherwise(0).cast("int")


def passes_flags(flag: Column, required: int, excluded: int) -> Column:
    return (flag.bitwiseAND(required) == required) & (flag.bitwiseAND(excluded) == 0)


def reference_length(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(0, 2, 3, 7, 8)), F.lit(0), lambda a, x: a + x["len"])


def consumed(cigar: Column) -> Column:
    """The length of a sequence that goes with the operations."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(0, 1, 4, 7, 8)), F.lit(0), lambda a, x: a + x["len"])


def query_length(seq: Column) -> Column:
    return F.when((seq == "*") | seq.isNull(), 0).otherwise(F.length(seq))


def stretches(cigar: Column) -> Column:
    """(op, q, r, len) of each operation: where it starts in the read and after the read's position."""
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<op:int,q:int,r:int,len:int>>").alias("out"))

    def add(a, x):
        q = a["q"] + F.when(x["op"].isin(0, 1, 4, 7, 8), x["len"]).otherwise(0)
        r = a["r"] + F.when(x["op"].isin(0, 2, 3, 7, 8), x["len"]).otherwise(0)
        one = F.struct(x["op"].alias("op"), a["q"].alias("q"), a["r"].alias("r"), x["len"].alias("len"))
        return F.struct(q.alias("q"), r.alias("r"), F.when(x["op"].isin(0, 2, 3, 7, 8) & (x["len"] > 0), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.coalesce(cigar, F.array().cast("array<struct<op:int,len:int>>")), start, add, lambda a: a["out"])


def _in_chunks(each: DataFrame, reference: DataFrame) -> DataFrame:
    """Stretches with ``_refs``, their letters of the reference: cut where a chunk ends, and without what is off the reference."""
    own = reference.select(F.col("contig"), F.col("length").alias("_length"), "chunk", "letters")
    start, end = F.col("pos") + F.col("_r"), F.col("pos") + F.col("_r") + F.col("_len")
    each = each.withColumn("chunk", F.explode_outer(F.sequence(F.shiftright(start, CHUNK), F.shiftright(end - 1, CHUNK)))).join(own, ["contig", "chunk"])
    low = F.greatest(start, F.shiftleft("chunk", CHUNK))
    each = each.withColumns({"_skip": low - start, "_to": F.least(end, F.shiftleft(F.col("chunk") + 1, CHUNK), F.col("_length").cast("int"))})
    each = each.withColumns({"_q": F.col("_q") + F.col("_skip"), "_r": F.col("_r") + F.col("_skip"), "_len": F.col("_to") - start - F.col("_skip")}).where("_len > 0")
    at = F.col("pos") + F.col("_r") - F.shiftleft("chunk", CHUNK) + MARGIN + 1
    return each.withColumn("_refs", F.split(F.substring(F.col("letters"), at, F.col("_len")), "")).drop("chunk", "letters", "_length", "_skip", "_to")


def positions(reads: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """A row for each reference position of each read, with ``kind``, ``rpos``, ``qpos`` (null without a base), ``letter`` (upper case, empty without a base), ``bq`` (-1 if not known) and the read's columns.

    ``reads`` has ``ok``, whether it passes the flag gates; all positions of one that doesn't are of kind FAIL. Bases past the end of the sequence are left out.
    Each stretch of the sequence is cut into letters once, so the work is linear in a read's length; what follows needs no sequence or qualities of whole
    reads, which are not carried into joins and windows. With a ``reference`` there is ``ref``, its letter, looked up once for a stretch; positions off it are gone.
    The generators are outer ones, as Spark otherwise asks for their arrays' sizes first, far below, which makes the arrays twice and in as few tasks as read the file.
    """
    each = reads.withColumn("qlen", F.coalesce(query_length(F.col("seq")), F.lit(0))).select("*", F.inline_outer(stretches(F.col("cigar"))).alias("_op", "_q", "_r", "_len")).where("_op IS NOT NULL")
    both = F.col("_op").isin(*CONSUMES_BOTH)
    kind = F.when(~F.col("ok"), FAIL).when(both, BASE).when(F.col("_op") == DELETION, DEL).otherwise(REF_SKIP)
    each = each.withColumn("kind", kind)
    if reference is not None:
        each = _in_chunks(each, reference)
    each = each.where((F.col("kind") != BASE) | (F.col("qlen") > F.col("_q")))
    own = F.split(F.upper(F.substring(F.col("seq"), F.col("_q") + 1, F.col("_len"))), "")
    each = each.withColumn("_letters", F.when(F.col("kind") == BASE, own).otherwise(F.array_repeat(F.lit(""), F.col("_len"))))
    each = each.select("*", F.posexplode_outer("_letters").alias("_k", "letter")).where("_k IS NOT NULL")
    if reference is not None:
        each = each.withColumn("ref", F.get("_refs", F.col("_k"))).drop("_refs")
    each = each.withColumn("rpos", F.col("pos") + F.col("_r") + F.col("_k")).withColumn("qpos", F.when(F.col("kind") == BASE, F.col("_q") + F.col("_k")))
    return each.withColumn("bq", F.coalesce(F.get("qual", F.col("qpos")), F.lit(-1))).drop("_op", "_q", "_r", "_len", "_letters", "_k")


def base_index(letter: Column) -> Column:
    """0 to 3 for ACGT, 4 for anything else."""
    return F.when(letter == "A", 0).when(letter == "C", 1).when(letter == "G", 2).when(letter == "T", 3).otherwise(4)


def complement(letters: Column) -> Column:
    return F.translate(letters, "ACGT", "TGCA")


def reverse_complement(letters: Column) -> Column:
    """Keeps case; N stays."""
    return F.translate(F.reverse(letters), "ATGCatgc", "TACGtacg")


def padded_slice(seq: Column, start: Column, end: Column) -> Column:
    """Letters from start (from 0) up to end, with N outside of the sequence."""
    size = F.length(seq)
    left = F.repeat(F.lit("N"), F.greatest(F.least(end, F.lit(0)) - start, F.lit(0)))
    low, high = F.greatest(start, F.lit(0)), F.least(end, size)
    right = F.repeat(F.lit("N"), F.greatest(end - F.greatest(start, size), F.lit(0)))
    return F.concat(left, F.when(high > low, F.substring(seq, low + 1, high - low)).otherwise(""), right)


def read_scope(bases: bool = True) -> dict[str, tuple[str, Column]]:
    """The variables of read expressions over columns of reads, or of their bases (``ref`` needs a column of that name)."""
    c = F.col
    long = lambda x: x.cast("bigint")
    sign = (1 - 2 * c("s")).cast("bigint")
    qlen = query_length(c("seq"))
    first, last = F.try_element_at("cigar", F.lit(1)), F.try_element_at("cigar", F.lit(-1))
    total = lambda op: F.aggregate(F.filter("cigar", lambda x: x["op"] == op), F.lit(0), lambda a, x: a + x["len"])
    one = {
        "mapq MAPQ mapping_quality": ("int", long(c("mapq"))),
        "flag flags FLAGS": ("int", long(c("flag"))),
        "strand STRAND": ("int", sign),
        "pos POS start": ("int", long(c("pos") + 1)),
        "endpos stop": ("int", long(c("pos") + reference_length(c("cigar")) + 1)),
        "tid refid": ("int", long(c("tid"))),
        "mtid": ("int", long(c("mtid"))),
        "mpos pnext": ("int", long(F.when(c("mpos") >= 0, c("mpos") + 1).otherwise(0))),
        "tlen insert_size": ("int", long(c("tlen"))),
        "qlen LEN length": ("int", long(qlen)),
        "rlen": ("int", long(reference_length(c("cigar")))),
        "sclen": ("int", long(total(4))),
        "hclen": ("int", long(total(5))),
        "n_indel indel_count": ("int", long(F.size(F.filter("cigar", lambda x: x["op"].isin(1, 2))))),
        "ncigar": ("int", long(F.size("cigar"))),
        "soft_clips_5_prime": ("int", long(F.when(first["op"] == 4, first["len"]).otherwise(0))),
        "soft_clips_3_prime": ("int", long(F.when((F.size("cigar") >= 2) & (last["op"] == 4), last["len"]).otherwise(0))),
        "is_reverse": ("int", long(F.when(c("flag").bitwiseAND(16) != 0, 1).otherwise(0))),
        "is_paired": ("int", long(F.when(c("flag").bitwiseAND(1) != 0, 1).otherwise(0))),
        "r1": ("int", long(F.when(c("flag").bitwiseAND(64) != 0, 1).otherwise(0))),
        "r2": ("int", long(F.when(c("flag").bitwiseAND(128) != 0, 1).otherwise(0))),
        "qname": ("str", c("qname")),
        "rname": ("str", F.coalesce(c("contig"), F.lit(""))),
        "mrname rnext": ("str", F.coalesce(c("mcontig"), F.lit(""))),
        "seq sequence": ("str", F.when(qlen > 0, c("seq")).otherwise("")),
        "qual": ("bytes", F.coalesce(c("qual"), F.array().cast("array<int>"))),
        "library": ("str", F.coalesce(F.try_element_at("tags", F.lit("LB"))["s"], F.lit(""))),
    }
    if bases:
        letter = c("letter")
        reverse = c("flag").bitwiseAND(16) != 0
        far = c("qlen") - c("qpos")
        one |= {
            "qpos QPOS": ("int", long(c("qpos"))),
            "bq BQ baseq": ("int", long(c("bq"))),
            "base BASE": ("str", F.when(c("s") == 1, complement(letter)).otherwise(letter)),
            "ref REF": ("str", c("ref")),
            "dist5 DIST5 distance_from_5prime": ("int", long(F.when(reverse, far).otherwise(c("qpos")))),
            "dist3 DIST3 distance_from_3prime": ("int", long(F.when(reverse, c("qpos")).otherwise(far))),
        }
    return {name: v for group, v in one.items() for name in group.split()}
