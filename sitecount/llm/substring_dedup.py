"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

A window is ``size`` consecutive words; one whose words also start anywhere else, in the same text or another, is repeated, and
each word that a repeated window covers is removed. The levels are lengths that double up to ``size``: 9, 18 and 35 for 35.

First level. Of the short windows inside each window the one with the least hash is its seed, so equal windows have equal seeds at equal
offsets, and neighbours mostly share one. Next levels. The seed is extended to twice its length, to the right where that stays inside
of the window, else to the left, so that equal windows have equal extensions. Neighbours with the same seed and extensions are one row, a
run, about a tenth of the words. Of each level's rows, those whose seed or extension occurs once end there with all their windows,
and only the others are looked at in the next one, until the last level is reached or none is left.

Last level. A run spans one context: the words from its first window's start to its last one's end. Contexts that occur
again settle all their windows. What is left are runs that differ from others with their extension at one end: there, one run of each
context is spread into windows of full length, and counted.

Texts are read once for all levels but the last. Hashes of 64 bits of each level and of the window must agree. Every count is a partial
aggregate before it is shuffled, and is written before rows are joined with it, so that AQE splits a hot key. No text, and no list for a
key, is gathered beyond one document.

Null or short texts have no windows. Repeated rows and equal texts are copies of each other, and are removed as such. Columns
other than the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, WordHash, drop, each, fmix, prefix, windows, written

SIZE = 35
#: The first level is at least half as long again as this, or the window's length.
LEAST = 6
#: A run has fewer windows than this; position and length share a number.
STEP = 4096


def levels(size: int) -> tuple[int, ...]:
    """Lengths that double up to ``size``."""
    out = [size]
    while out[0] > 2 * LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return tuple(out)


def extensions(at: np.ndarray, size: int) -> list[np.ndarray]:
    """For windows 0, 1, ... with seeds at ``at``, where the seed's extension of each level between the first and the last starts."""
    lengths, first = levels(size), np.arange(len(at))
    out, start = [], at
    for before, length in zip(lengths, lengths[1:-1], strict=False):
        start = np.where(start - first + length <= size, start, start + before - length)
        out.append(start)
    return out


def runs(hashes: np.ndarray, size: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(place, key of each level but the last, context) for each run; place is first window * STEP + windows after the first."""
    lengths = levels(size)
    n = len(hashes) - size + 1
    none = np.zeros(0, dtype=np.uint64)
    if n <= 0:
        return none.astype(np.int64), *[none] * max(1, len(lengths) - 1), none
    sums = prefix(hashes, powers)
    short = windows(sums, lengths[0], powers)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(short, size - lengths[0] + 1).argmin(axis=1)
    starts = [at, *extensions(at, size)]
    new = np.any([s[1:] != s[:-1] for s in starts], axis=0)
    first = np.concatenate(([0], np.flatnonzero(new) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    # how the extensions lie, the same for equal windows; runs of one seed differ in it
    shape = np.zeros(len(first), dtype=np.uint64)
    for s in starts[1:]:
        shape = shape * np.uint64(size + 1) + (at[first] - s[first]).astype(np.uint64)
    keys = [fmix(windows(sums, length, powers)[s[first]] + fmix(shape + np.uint64(1))) for length, s in zip(lengths, starts, strict=False)]
    spread = (last - first).astype(np.uint64)
    context = (sums[last + size] - sums[first]) * powers.upto(n)[1][first]
    context = fmix(context + fmix((at[first] - first).astype(np.uint64) * np.uint64(STEP) + spread + np.uint64(1)))
    return first * STEP + (last - first), *keys, context


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in kinds], names=list(kinds))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(size: int) -> list[str]:
    return [f"key{length}" for length in levels(size)[:-1] or (size,)]


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """(a, b, place, keys by level, context) of every run."""
    names = ["place", *_keys(size), "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHash(), Powers()
        for batch in batches:
            a, b = (np.asarray(batch.column(k)) for k in (0, 1))
            out: list[tuple] = []
            n: list[int] = []
            for t in each(batch.column(2)):
                found = t.split() if t else []
                got = runs(hashes.of(found), size, powers) if len(found) >= size else None
                n.append(len(got[0]) if got else 0)
                if got:
                    out.append(got)
            if out:
                columns = {c: _signed(np.concatenate(x)) for c, x in zip(names, zip(*out, strict=True), strict=True)}
                yield _batch({"a": np.repeat(a, n), "b": np.repeat(b, n)} | columns, dict.fromkeys(("a", "b", *names), pa.int64()))

    return docs.select("a", "b", F.col("t").cast("binary").alias("t")).mapInArrow(run, ", ".join(f"{c} long" for c in ("a", "b", *names)))


def _spread(rows: DataFrame, size: int) -> DataFrame:
    """(a, b, i, seed, window, weight) for each window of the listed runs; ``rows`` has a, b, id, t and lists places, seeds and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHash(), Powers()
        names = ("a", "b", "i", "seed", "window", "weight")
        for batch in batches:
            out = []
            col = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            a, b = np.asarray(col["a"]), np.asarray(col["b"])
            for k, t in enumerate(each(col["t"])):
                place, seed, weight = (col["open"][k].values.field(f).to_numpy() for f in ("place", "seed", "n"))
                of_size = windows(prefix(hashes.of(t.split()), powers), size, powers)
                first, many = place // STEP, place % STEP + 1
                i = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                out.append((np.full(len(i), a[k]), np.full(len(i), b[k]), i, np.repeat(seed, many), _signed(of_size[i]), np.repeat(np.minimum(weight, 2), many)))
            if out:
                yield _batch(dict(zip(names, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)), dict.fromkeys(names, pa.int64()))

    return rows.mapInArrow(run, "a long, b long, i long, seed long, window long, weight long")


def survivors(docs: DataFrame, size: int) -> DataFrame:
    """(a, b, place, seed, context) of the runs that no level but the last one ends; ``seed`` is the key of the longest of these."""
    alive = written(_scan(docs, size), "runs")
    for key in _keys(size):
        twice = written(alive.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "twice")
        left = written(alive.join(twice, key).withColumnRenamed(key, "seed") if key == _keys(size)[-1] else alive.join(twice, key).drop(key), "alive")
        drop(alive, twice)
        alive = left
    return alive


def candidates(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Settled runs (a, b, place), all of whose windows are repeated, and the windows of open ones. ``docs`` has a, b, id and t; a and b tell apart all rows but equal ones."""
    alive = survivors(docs, size)
    contexts = alive.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "place")).alias("one"))
    contexts = written(contexts, "contexts")
    settled = alive.join(contexts.where("n > 1").select("seed", "context"), ["seed", "context"]).select("a", "b", "place")
    open_seeds = written(contexts.where("n = 1").select("seed").distinct(), "open")  # a plain table, so that AQE can split a hot seed in the join
    lists = contexts.join(open_seeds, "seed", "left_semi").groupBy(F.col("one.a").alias("a"), F.col("one.b").alias("b")).agg(F.collect_list(F.struct(F.col("one.place").alias("place"), "seed", "n")).alias("open"))
    spread = _spread(docs.join(lists, ["a", "b"]), size)
    return settled, spread


def plan(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, id, t and ``places``, the repeated runs of each row (null: none)."""
    ident = F.col(f"`{id_col}`")
    rows = docs.select(F.xxhash64(ident).alias("a"), F.xxhash64(F.col(f"`{text}`"), ident.isNull()).alias("b"), ident.alias("id"), F.col(f"`{text}`").cast("binary").alias("t"))
    settled, spread = candidates(rows, size)
    spread = written(spread, "windows")
    again = written(spread.groupBy("seed", "window").agg(F.sum("weight").alias("n")).where("n > 1").select("seed", "window"), "again")
    edges = spread.where("weight = 1").join(again, ["seed", "window"]).select("a", "b", (F.col("i") * STEP).alias("place"))
    places = settled.unionByName(edges).groupBy("a", "b").agg(F.collect_list("place").alias("places"))
    return rows.join(places, ["a", "b"], "left")


def covered(n: int, places: np.ndarray, size: int) -> np.ndarray:
    """Which of n words the windows of the runs cover."""
    first, many = places // STEP, places % STEP
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + many + size, n), -1)
    return np.cumsum(step[:n]) > 0


def deduplicate(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """One row per row: the id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            n_words, n_removed, digest, kept = [], [], [], []
            for k, t in enumerate(each(col["t"])):
                found = t.split() if t else []
                n_words.append(len(found))
                if col["places"][k].is_valid:
                    gone = covered(len(found), col["places"][k].values.to_numpy(), size)
                    found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(found))
                whole = b" ".join(found)
                digest.append(hashlib.sha256(whole).hexdigest())
                if texts:
                    kept.append(whole.decode())
            arrays = [col["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.string())] if texts else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts])

    kind = docs.schema[id_col].dataType.simpleString()
    out = plan(docs, size, id_col, text).mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - {SIZE - 2})) AS i, w FROM d WHERE len(w) >= {SIZE}),
g AS (SELECT r, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS g FROM p),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
c AS (SELECT r, list(DISTINCT i + k) AS gone FROM t, (SELECT unnest(range({SIZE})) AS k) GROUP BY r),
k AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        CASE WHEN gone IS NULL THEN w ELSE list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL) END AS kept
      FROM d LEFT JOIN c ON d.r = c.r)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
