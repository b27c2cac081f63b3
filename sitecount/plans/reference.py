"""Reference sequences in chunks, joined late: only sites, or bases whose filter asks for it, look up their letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a chunk's length; letters that a chunk holds beyond either end, for motifs.
CHUNK, MARGIN = 14, 256


def chunked(contigs: DataFrame) -> DataFrame:
    """(contig, length, chunk, letters) of sequences (contig, seq): upper case, ``MARGIN`` letters more at both ends, N outside.

    A sequence is cut once, in one pass; a chunk takes its margins from its neighbours.
    """
    size = 1 << CHUNK
    own = contigs.select("contig", F.length("seq").alias("length"), F.upper("seq").alias("seq"))
    pieces = F.when(F.col("length") > 0, F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(F.lit("")))
    own = own.select("contig", "length", pieces.alias("_all"))
    near = lambda i: F.coalesce(F.get("_all", i), F.lit(""))
    before, after = (lambda i: F.right(near(i - 1), F.lit(MARGIN))), (lambda i: F.left(near(i + 1), F.lit(MARGIN)))
    with_margins = F.transform("_all", lambda x, i: F.concat(F.lpad(before(i), MARGIN, "N"), F.rpad(F.concat(x, after(i)), size + MARGIN, "N")))
    return own.select("contig", "length", F.posexplode(with_margins).alias("chunk", "letters"))


def letters_at(pos: Column, before: int = 0, after: int = 0) -> Column:
    at = pos.cast("int") - F.shiftleft("chunk", CHUNK) + MARGIN - before + 1
    return F.substring(F.col("letters"), at, F.lit(before + after + 1))


def with_reference(rows: DataFrame, reference: DataFrame, pos: str, pad: int = 0) -> DataFrame:
    """Rows with ``ref`` and ``motif`` (2 * pad + 1 letters); rows off the reference are gone. Spark broadcasts the reference where it is small."""
    if pad > MARGIN:
        raise ValueError(f"a motif reaches at most {MARGIN} letters")
    own = reference.select(F.col("contig"), F.col("length").alias("contig_length"), "chunk", "letters")
    joined = rows.withColumn("chunk", F.shiftright(F.col(pos).cast("int"), CHUNK)).join(own, ["contig", "chunk"])
    joined = joined.where(F.col(pos) < F.col("contig_length"))
    return joined.withColumn("ref", letters_at(F.col(pos))).withColumn("motif", letters_at(F.col(pos), pad, pad)).drop("chunk", "letters", "contig_length")
