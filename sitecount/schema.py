"""Schemas of reads and sites, flag bits, and the base alphabet."""

from __future__ import annotations

from pyspark.sql import types as T

# SAM flag bits.
FLAGS = {
    "paired": 1, "proper_pair": 2, "unmap": 4, "munmap": 8, "reverse": 16, "mreverse": 32,
    "read1": 64, "read2": 128, "secondary": 256, "qcfail": 512, "dup": 1024, "supplementary": 2048,
}
DEFAULT_EXCLUDED = FLAGS["unmap"] | FLAGS["secondary"] | FLAGS["qcfail"] | FLAGS["dup"]
CIGAR_OPS = "MIDNSHP=X"
BASES = "ACGTN"
SLOTS = 4
COUNTS = [f"{b.lower()}{k}" for b in BASES for k in range(SLOTS)]
EVENTS = ["del", "ref_skip", "fail"]

CIGAR = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("len", T.IntegerType())]))
TAG = T.StructType([T.StructField("t", T.StringType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType())])
READS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("tid", T.IntegerType()),
        T.StructField("contig", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", CIGAR),
        T.StructField("mtid", T.IntegerType()),
        T.StructField("mcontig", T.StringType()),
        T.StructField("mpos", T.IntegerType()),
        T.StructField("tlen", T.IntegerType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.ArrayType(T.IntegerType())),
        T.StructField("tags", T.MapType(T.StringType(), TAG)),
    ]
)


class CountingError(Exception):
    """An error with the exit code that the command line gives for it."""

    code = 1


class ExpressionError(CountingError):
    code = 2


class UnsupportedExpression(ExpressionError):
    """Valid in the language, but not offered here."""


class InputError(CountingError):
    code = 3


class RegionError(CountingError):
    code = 4


def flag_mask(spec: str | int | None) -> int:
    """A mask from names (any case), hexadecimal or decimal numbers, joined by commas."""
    if spec is None or spec == "":
        return 0
    if isinstance(spec, int):
        return spec
    out = 0
    for part in str(spec).split(","):
        part = part.strip()
        if part.lower() in FLAGS:
            out |= FLAGS[part.lower()]
        else:
            try:
                out |= int(part, 0)
            except ValueError:
                raise CountingError(f"unknown flag: {part}") from None
    return out


def format_options(spec: str | None) -> tuple[int, int]:
    """(required, excluded) masks of an input format option: ``reqflags=..``, ``exclflags=..``, or bare names, which are required."""
    required = excluded = 0
    for part in filter(None, (spec or "").split(",")):
        name, eq, value = part.partition("=")
        if not eq:
            required |= flag_mask(part)
        elif name.strip().lower() == "reqflags":
            required |= flag_mask(value)
        elif name.strip().lower() == "exclflags":
            excluded |= flag_mask(value)
    return required, excluded
