"""Counting reads as files arrive in a directory, SAM text or Parquet reads.

``running_counts`` is one stateful aggregate over all bases; mates are not matched there. ``count_arrivals`` counts each batch of files as a whole,
with mates matched as in a batch job, and keeps its counts in a folder of its own, which a repeated batch replaces; ``totals`` adds them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.bases import BASE, base_index, positions
from ..plans.pileup import Config, gated, sites
from ..schema import BASES, COUNTS, EVENTS, READS
from ..sources.sam import parse


def stream_reads(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of reads."""
    return spark.readStream.schema(READS).parquet(path)


def stream_sam(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """SAM files, plain or compressed, on known contigs (tid, contig, length). A line's own hash stands for its place, which only breaks ties between equally good mates."""
    return parse(spark.readStream.text(path).withColumn("place", F.xxhash64("value")), contigs)


def running_counts(reads: DataFrame, config: Config = Config()) -> DataFrame:
    """Counts of bases by position and strand so far, for the complete or update mode. Mates count twice where they overlap."""
    rows = positions(gated(reads, config)).where(F.col("kind") == BASE)
    rows = rows.withColumn("b", base_index(F.col("letter")))
    return rows.groupBy("tid", "contig", F.col("rpos").alias("pos"), "s").agg(*[F.count(F.when(F.col("b") == k, 1)).alias(x.lower()) for k, x in enumerate(BASES)])


def count_arrivals(reads: DataFrame, out: str, checkpoint: str, config: Config = Config(), reference: DataFrame | None = None, **options) -> StreamingQuery:
    """Start to count the files of a stream into ``out``, one folder for each batch. Mates are matched within a batch; ``options`` go to the writer (``availableNow=True`` stops when all is read)."""

    def count(batch: DataFrame, number: int) -> None:
        sites(batch, reference, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(**options or {"processingTime": "10 seconds"}).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Sites (tid, contig, pos, s, counts) over all batches so far."""
    return spark.read.parquet(out).groupBy("tid", "contig", "pos", "s").agg(*[F.sum(c).alias(c) for c in (*COUNTS, *EVENTS)])
