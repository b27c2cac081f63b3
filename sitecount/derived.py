"""An alignment view over the events table: reads and a reference defined by whole-number arithmetic on ``event_id``.

Each event is a read of 30 bases; two neighbouring ids are mates that know each other's place. Five CIGAR shapes, four contigs of 500 letters, some
unreadable bases. The SQL twin is in ``oracles.READS`` and ``oracles.entries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.reference import chunked

CONTIGS, LENGTH, READ, CLIP = 4, 500, 30, 5
#: Reads that one task unnests at most, about.
PART = 1 << 16
#: (operation, length) of each shape.
SHAPES = (((0, 30),), ((4, CLIP), (0, 25)), ((0, 10), (2, 2), (0, 20)), ((0, 10), (1, 3), (0, 17)), ((0, 12), (3, 4), (0, 18)))


def _letters(cid: int) -> str:
    return "".join("ACGT"[(p * 7 + p // 3 + cid * 5) % 4] for p in range(LENGTH))


def reference(spark: SparkSession) -> DataFrame:
    """Four short contigs, broadcast: Spark doesn't know the size of rows from Python, and would sort all reads for the join."""
    return F.broadcast(chunked(spark.createDataFrame([(f"c{cid}", _letters(cid)) for cid in range(CONTIGS)], "contig string, seq string")))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts the reads go, by their number, which Parquet's footers tell: what a task holds doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // PART))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rid")
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("rid"))
    # a few bytes become a read: spread them before they grow, as one file's part holds very many; by id, as what is counted by read then stays where it is
    ids = ids.repartition(parts(spark, sf_dir), "rid")
    # the part's number, which is never below 0, keeps Spark from testing what is made of the ids before they are spread
    ids = ids.withColumn("frag", F.floor(r / 2) + F.when(F.spark_partition_id() < 0, 1).otherwise(0)).withColumn("mate", r % 2)
    frag, mate = F.col("frag"), F.col("mate")
    single = frag % 7 == 0
    out = ids.withColumn("cid", frag % CONTIGS).withColumn("pos", ((frag * 37) % 400 + mate * (frag % 41)).cast("int"))
    flag = F.when(single, 0).when(mate == 0, 65).otherwise(129) + 16 * ((frag + mate) % 2)
    for step, bit in ((23, 1024), (29, 512), (31, 256)):
        flag = flag + F.when(r % step == 0, bit).otherwise(0)
    shape = F.element_at(F.array(*[F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).alias("len")) for op, n in s]) for s in SHAPES]), (r % 5 + 1).cast("int"))
    # a sequence is one or two stretches of the reference: up to the shape's indel, and from there on with a shift; ahead of the reference stand copies of its first letter
    by_shape = lambda values: F.element_at(F.array(*map(F.lit, values)), (r % 5 + 1).cast("int"))
    whole = F.element_at(F.array(*[F.lit(_letters(c)[0] * CLIP + _letters(c)) for c in range(CONTIGS)]), (F.col("cid") + 1).cast("int"))
    out = out.withColumns({"_cut": by_shape((0, 0, 10, 10, 12)), "_rest": by_shape((0, -CLIP, 2, -3, 4)), "_whole": whole})
    at = F.col("pos") + CLIP + 1
    out = out.withColumn("_seq", F.concat(F.substring(F.col("_whole"), at, F.col("_cut")), F.substring(F.col("_whole"), at + F.col("_cut") + F.col("_rest"), READ - F.col("_cut"))))
    # every eleventh base is the next letter, from the place where (7 rid + 3 place) % 11 is 0; 4 is the inverse of 3
    first = ((11 - (r * 7) % 11) * 4 % 11).cast("int")
    seq = F.rpad("_seq", 100, "-")  # room for changes beyond the end, which are cut off
    for step in range(0, READ, 11):
        place = first + step + 1
        seq = F.overlay(seq, F.translate(F.substring(F.col("_seq"), place, F.lit(1)), "ACGT", "CGTA"), place)
    seq = F.substring(F.overlay(seq, F.lit("N"), ((97 - (r * 5) % 97) % 97 + 1).cast("int")), 1, READ)
    qualities = F.element_at(F.array(*[F.array(*[F.lit((k + q * 17) % 40 + 2) for q in range(READ)]) for k in range(40)]), ((r * 31) % 40 + 1).cast("int"))

    paired = ~single
    there = ((frag * 37) % 400 + (1 - mate) * (frag % 41)).cast("int")
    none = F.lit(None)
    tag = lambda v: F.struct(F.lit("i").alias("t"), v.cast("long").alias("i"), none.cast("double").alias("f"), none.cast("string").alias("s"))
    tags = F.map_from_entries(F.concat(F.when(r % 10 != 9, F.array(F.struct(F.lit("NS").alias("k"), tag(r % 4).alias("v")))).otherwise(F.array()), F.array(F.struct(F.lit("Yf").alias("k"), tag(r % 3).alias("v")), F.struct(F.lit("Zf").alias("k"), tag(r % 6).alias("v")))))
    return out.select(
        r.alias("ord"),
        F.when(single, F.concat(F.lit("q"), frag, F.lit("_"), mate)).otherwise(F.concat(F.lit("q"), frag)).alias("qname"),
        flag.cast("int").alias("flag"),
        F.col("cid").cast("int").alias("tid"),
        F.concat(F.lit("c"), "cid").alias("contig"),
        "pos",
        ((r * 13) % 61).cast("int").alias("mapq"),
        shape.alias("cigar"),
        F.when(paired, F.col("cid")).otherwise(-1).cast("int").alias("mtid"),
        F.when(paired, F.concat(F.lit("c"), "cid")).otherwise("").alias("mcontig"),
        F.when(paired, there).otherwise(-1).alias("mpos"),
        F.when(paired, (1 - 2 * mate) * (frag % 41 + READ)).otherwise(0).cast("int").alias("tlen"),
        seq.alias("seq"),
        qualities.alias("qual"),
        tags.alias("tags"),
    )
