"""What the operators share: words, hashes, columns with clashing names, and cut lineage.

Words are runs of bytes other than space and 0x09-0x0D. ``bytes.split`` without arguments splits at exactly
those, so Python code works on UTF-8 bytes; columns use ``words``.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of the 64-bit finalizer.
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def words(text: Column) -> Column:
    """The words of a text; null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, "     ")
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one of its own in local mode, as in tests; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint_")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """The rows, from a Parquet table in the shared folder: their lineage is cut, and lost executors cost nothing that was done before.

    ``slim`` is for tables of a few numbers a row, without texts or sketches: they are written by fewer tasks, in proportion to the cluster, as
    their many steps would else be spent on opening files. The table goes when the session ends, or with ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if slim:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    release(spark)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    for made in _scopes[-1:]:
        made.append(out)
    return out


_scopes: list[list] = []


@contextmanager
def scratch() -> Iterator[list]:
    """The tables that are ``written`` meanwhile, for ``drop``."""
    made: list = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def drop(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "__dict__", {}).get("_table"):
            fs, at = _hadoop(df.sparkSession, path)
            with suppress(Exception):  # what can't be deleted now goes with the session
                fs.delete(at, True)


#: Seconds between two collections, and when the last one was.
_EVERY, _last = 4.0, [0.0]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, every few seconds; without it they stay until the driver's heap fills."""
    if time.monotonic() - _last[0] >= _EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _last[0] = time.monotonic()


def fmix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash, over an array."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_B
    return x ^ (x >> np.uint64(33))


def each(column: pa.Array) -> Iterator:
    """The values of a column one by one, so that no batch is held twice."""
    return (x.as_py() for x in column)


class WordHash(dict):
    """64-bit hashes by word; forgets all when it holds ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            ones = np.full(size, BASE, dtype=np.uint64)
            ones[0] = 1
            self.up = np.cumprod(ones)
            ones = np.full(size, BACK, dtype=np.uint64)
            ones[0] = 1
            self.down = np.cumprod(ones)
        return self.up[:n], self.down[:n]


def prefix(hashes: np.ndarray, powers: Powers) -> np.ndarray:
    """S with S[i] = sum of hashes[j] * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers.upto(len(hashes))[0], out=out[1:])
    return out


def windows(sums: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """A hash of each run of ``size`` hashes, the same for equal runs wherever they stand."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return fmix((sums[size:] - sums[:n]) * powers.upto(n)[1])
