"""SAM text, plain or compressed, as reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..schema import CIGAR_OPS, READS, InputError

_ORD = StructField("ord", READS["ord"].dataType)


def header_lines(lines: DataFrame) -> DataFrame:
    """(tid, contig, length) from ``@SQ`` lines, numbered in the header's order."""
    sq = lines.where(F.col("value").startswith("@SQ"))
    field = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]+)", 1)
    named = sq.select(F.col("place"), field("SN").alias("contig"), field("LN").cast("long").alias("length"))
    rows = named.orderBy("place").collect()  # as many as the header has contigs
    spark = lines.sparkSession
    return spark.createDataFrame([(k, r.contig, r.length) for k, r in enumerate(rows)], "tid int, contig string, length long")


def _tag(field: Column) -> Column:
    """XX:T:value as an entry of a map; the letter is i, f, s, or B for arrays, which keep their text."""
    kind, value = F.substring(field, 4, 1), F.substring(field, F.lit(6), F.length(field))
    letter = F.when(kind == "i", "i").when(kind == "f", "f").when(kind.isin("Z", "H", "A"), F.when(kind == "A", "i").otherwise("s")).when(kind == "B", "B")
    number = F.when(kind == "A", F.ascii(value).cast("long")).when(kind == "i", value.try_cast("long"))
    return F.struct(
        F.substring(field, 1, 2).alias("k"),
        F.struct(letter.alias("t"), number.alias("i"), F.when(kind == "f", value.try_cast("double")).alias("f"), F.when(kind.isin("Z", "H", "B"), value).alias("s")).alias("v"),
    )


def parse(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reads from alignment lines (value, place: the order of the file)."""
    f = F.split(F.rtrim(F.col("value")), "\t")
    part = lambda k: F.get(f, F.lit(k))
    ops = F.regexp_extract_all(part(5), F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    code = lambda x: (F.call_function("instr", F.lit(CIGAR_OPS), F.right(x, F.lit(1))) - 1).cast("int")
    cigar = F.transform(ops, lambda x: F.struct(code(x).alias("op"), F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("len")))
    qual = F.when(part(10) == "*", F.lit(None).cast("array<int>")).otherwise(F.transform(F.split(part(10), ""), lambda x: F.ascii(x) - 33))
    given = F.filter(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.substring(x, 4, 1).isin("A", "i", "f", "Z", "H", "B"))
    names = F.transform(given, lambda x: F.left(x, F.lit(2)))
    tags = F.transform(F.filter(given, lambda x, i: F.array_position(names, F.left(x, F.lit(2))) == i + 1), _tag)  # the first of a name
    rows = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11)).select(
        F.col("place").alias("ord"),
        part(0).alias("qname"),
        part(1).try_cast("int").alias("flag"),
        F.when(part(2) != "*", part(2)).alias("contig"),
        (part(3).try_cast("int") - 1).alias("pos"),
        part(4).try_cast("int").alias("mapq"),
        cigar.alias("cigar"),
        F.when(part(6) == "=", part(2)).when(part(6) != "*", part(6)).otherwise("").alias("mcontig"),
        (part(7).try_cast("int") - 1).alias("mpos"),
        part(8).try_cast("int").alias("tlen"),
        part(9).alias("seq"),
        qual.alias("qual"),
        F.map_from_entries(tags).alias("tags"),
    )
    known = F.broadcast(contigs.select("tid", "contig"))  # as many rows as the header has contigs
    mates = F.broadcast(contigs.select(F.col("tid").alias("mtid"), F.col("contig").alias("mcontig")))
    rows = rows.join(known, "contig", "left").join(mates, "mcontig", "left")
    rows = rows.withColumns({"tid": F.coalesce("tid", F.lit(-1)), "mtid": F.coalesce("mtid", F.lit(-1))})
    return rows.select(*[F.col(x.name).cast(x.dataType) for x in StructType([_ORD, *READS.fields[1:]])])


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reads, contigs) of a SAM file; its lines are numbered by file offset order, which breaks ties between reads."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    contigs = header_lines(lines)
    if contigs.isEmpty():
        raise InputError(f"{path} has no contigs in its header")
    return parse(lines, contigs), contigs

