"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles, hashed to 64 bits. The hash space is cut into ``REGISTERS`` ranges; of the least hash in
each a register keeps the number of leading zeros (6 bits) and the bits after the first one (10 bits). A range without hashes copies
the register of another, picked by a fixed random priority, so that sets with few shingles collide as often as their similarity says.
``ROWS`` neighbouring registers make a band; documents that agree in a band share a bucket.

Sets that are equal form a class, which is one node, so exact copies meet nowhere. Candidates are taken in rounds, and a round only
looks at pairs whose classes aren't yet known to be connected:

1. each class with the least one of its buckets that shares most buckets with it;
2. within buckets that still hold several components, each class with one drawn by a hash of the bucket;
3. within buckets that still do, what is left: pairs across components in buckets of at most ``FEW`` classes, and for larger
   buckets those that an exact filter leaves (``crowded``): classes of overlapping buckets have one of them as pivot, and only pairs
   that share rare enough differences from it can be linked without both being linked to it.

The last round leaves no bucket-sharing pair across components that could be linked untested, whatever the first two missed; they only make
it short. Pairs first pass the size ratio and the similarity estimated from the registers, corrected for chance collisions, with a margin
of six standard deviations; what passes is confirmed on full sets. At a similarity of 0.8 a pair shares no bucket with probability
(1 - 0.8 ** 6) ** 42, about 3 in a million.

Null or empty texts have an empty set, are linked with nothing and stay. A row is known by its id and text, so that rows that share an id but
not the text are looked at each, and any id is as good as another; a group's component is its least id, and null if all of its ids are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Powers, WordHash, drop, each, fmix, prefix, windows, written
from .components import components

BANDS, ROWS, MANTISSA = 42, 6, 10
REGISTERS = BANDS * ROWS
PERCENT = 80
#: Classes of a bucket up to which its pairs are tested one by one.
FEW = 16


class Shingles:
    """Distinct shingle hashes of a text, sorted."""

    def __init__(self, size: int):
        self.size, self.hashes, self.powers = size, WordHash(), Powers()

    def of(self, text: bytes | None) -> np.ndarray:
        found = text.lower().split() if text else []
        if not found:
            return np.zeros(0, dtype=np.uint64)
        size = min(self.size, len(found))
        got = windows(prefix(self.hashes.of(found), self.powers), size, self.powers)
        if size < self.size:  # a short text's only shingle differs from longer ones
            got = fmix(got + np.uint64(size))
        return np.unique(got)


class Sketch:
    """Registers of sorted distinct hashes."""

    def __init__(self):
        rng = np.random.default_rng(20_17)
        step = (1 << 64) // REGISTERS
        self.bounds = np.array([i * step for i in range(REGISTERS)], dtype=np.uint64)
        self.priority = rng.permuted(np.tile(np.arange(REGISTERS, dtype=np.int32), (REGISTERS, 1)), axis=1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.bounds)
        end = np.append(at[1:], len(hashes))
        full = np.flatnonzero(at < end)
        # the offset within a range, spread over 64 bits
        offset = (hashes[at[full]] - self.bounds[full]) * np.uint64(REGISTERS)
        top = (offset >> np.uint64(11)).astype(np.float64)
        bits = np.frexp(top)[1]  # of the upper 53
        zeros = np.minimum(53 - bits, 63)
        shift = np.minimum(zeros + 1, 63).astype(np.uint64)
        mantissa = (offset << shift) >> np.uint64(64 - MANTISSA)
        out = np.zeros(REGISTERS, dtype=np.uint16)
        out[full] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
        if len(full) < REGISTERS:
            empty = np.flatnonzero(at >= end)
            out[empty] = out[full[self.priority[np.ix_(empty, full)].argmin(axis=1)]]
        return out


def estimate(a: np.ndarray, b: np.ndarray, ratio: np.ndarray | float = 1.0) -> np.ndarray:
    """Similarity from rows of registers: the part that agrees, without what agrees by chance. ``ratio`` is that of the sets' sizes.

    The least hashes of two unlike sets of m and n are about exponential with these rates, so they fall into the same cell of a
    register, v / 2 ** MANTISSA wide at a hash v up to rounding by powers of two, with probability m n / (m + n) ** 2 / 2 ** MANTISSA / (2 ln 2).
    """
    chance = ratio / (1 + ratio) ** 2 / (1 << MANTISSA) / (2 * np.log(2))
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def row_key(id_col: str, text: str) -> tuple[Column, Column]:
    """Two hashes that tell apart all rows but those of equal id and text."""
    ident, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    return F.xxhash64(ident), F.xxhash64(t, ident.isNull())


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(a, b, id, n, digest, registers) for each row (a, b, id, t); an empty set has a null digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch = Shingles(size), Sketch()
        for batch in batches:
            n, digest, registers = [], [], []
            for t in each(batch.column(3)):
                got = shingles.of(t)
                n.append(len(got))
                digest.append(xxhash.xxh3_128_digest(got.tobytes()) if len(got) else None)
                registers.append(sketch.of(got).tobytes() if len(got) else None)
            made = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["a", "b", "id", "n", "digest", "registers"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"a long, b long, id {kind}, n long, digest binary, registers binary")


def band_keys(registers: Column) -> Column:
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.substring(registers, 1 + k * width, width), F.lit(k)) for k in range(BANDS)])


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose sizes and estimated similarity allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(r.as_buffer(), dtype=np.uint16) for r in batch.column(k)]) for k in (2, 3))
            less, more = (np.asarray(batch.column(k)) for k in (4, 5))
            margin = 6 * np.sqrt(least * (1 - least) / np.minimum(REGISTERS, more))
            yield batch.select([0, 1]).filter(pa.array(estimate(a, b, less / more) >= least - margin))

    own = sketches.select("node", "n", "registers")
    x = own.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("registers").alias("rx"))
    y = own.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("registers").alias("ry"))
    sized = pairs.join(x, "x").join(y, "y").where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    return sized.select("x", "y", "rx", "ry", F.least("nx", "ny").alias("less"), F.greatest("nx", "ny").alias("more")).mapInArrow(run, "x long, y long")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the classes in ``wanted`` (node, a, b); ``docs`` has a, b and t. The only step that moves texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles.of(t).tobytes() for t in each(batch.column(1))], pa.binary())], names=["node", "hashes"])

    found = docs.join(wanted.select("node", "a", "b"), ["a", "b"]).select("node", "t").mapInArrow(run, "node long, hashes binary")
    return written(found.dropDuplicates(["node"]), "sets")  # equal rows are equal sets


def _hashes(x: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype=np.uint64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(map(_hashes, batch.column(2)), map(_hashes, batch.column(3)), strict=True):
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"h{n}")) for n in "xy")
    return pairs.join(y, "y").join(x, "x").select("x", "y", "hx", "hy").mapInArrow(run, "x long, y long")


def differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(crowd, node, c, pivot, n, f, guest, probe, index, tokens) for ``members`` (crowd, node, c, pivot).

    With k = (100 - percent) / (100 + percent), sets x and y are linked where their difference has at most k (|x| + |y|) elements. Let dx
    and dy be their differences from the pivot p. What x and y differ by is dx and dy without what these share, so a link needs
    |dx & dy| >= (f(x) + f(y)) / 2 with f(x) = |dx| - k |x| (here times 100 + percent). A ``guest`` is not linked to p: f(x) > k |p|. As |y| <= |p| + |dy|, a guest
    and any other set share at least one difference, and ``probe`` and ``index`` are how many of its rarest differences a set has to be looked up by, as
    a guest with any other and as any with a guest, for the rarest shared one to be among them.
    """
    whole = 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for x, p in zip(map(_hashes, batch.column(4)), map(_hashes, batch.column(5)), strict=True):
                d = np.setxor1d(x, p, assume_unique=True)
                f, reach = whole * len(d) - (100 - percent) * len(x), (100 - percent) * len(p)
                as_guest = max(1, -(-(f - reach) // 200))
                as_any = max(1, (reach + f) // (2 * whole) + 1)
                for c, v in zip(cols, (len(x), f, f > reach, max(0, len(d) - as_guest + 1) if f > reach else 0, max(0, len(d) - as_any + 1), d.view(np.int64)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=["crowd", "node", "c", "pivot", "n", "f", "guest", "probe", "index", "tokens"])

    pivots = written(members.select("crowd", F.col("pivot").alias("node")).distinct().join(sets, "node").select("crowd", F.col("hashes").alias("lead")), "pivots")
    both = members.join(sets, "node").join(pivots, "crowd").select("crowd", "node", "c", "pivot", "hashes", "lead")
    return both.mapInArrow(run, "crowd long, node long, c long, pivot long, n long, f long, guest boolean, probe long, index long, tokens array<long>")


def crowded(there: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For ``there`` (key, node, c, many, least): links (x, y) with pivots, and candidates (x, y) across components that hold all other links between nodes that share a key.

    Differences are taken in the order of their frequency in the crowd, so that a pair is met by few rare ones, and a place in that order bounds how many two sets can still share.
    """
    crowd = written(components(there.select(F.col("node").alias("x"), F.col("least").alias("y"))), "crowds", slim=True)
    weight = there.groupBy("node", "c").agg(F.sum("many").alias("met")).join(crowd, "node").withColumnRenamed("component", "crowd")
    weight = written(weight, "weights", slim=True)
    lead = written(weight.groupBy("crowd").agg(F.max(F.struct("met", (-F.col("node")).alias("node"))).alias("best")).select("crowd", (-F.col("best.node")).alias("pivot")), "leads", slim=True)
    found = written(differences(weight.join(lead, "crowd").select("crowd", "node", "c", "pivot"), sets, percent), "differences")
    links = found.where("NOT guest AND node <> pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y"))
    each = found.select("crowd", "node", F.explode("tokens").alias("token"))
    rarity = written(each.groupBy("crowd", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "rarity", slim=True)
    # a difference that one set alone has comes first and meets nothing
    shared = each.join(rarity, ["crowd", "token"])
    own = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    placed = shared.withColumn("own", own).join(found.select("node", "c", "n", "f", "probe", "index", F.size("tokens").alias("d")), "node")
    alone = F.col("d") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    placed = placed.withColumn("place", F.col("own") + alone - 1).where(F.col("place") < F.greatest("probe", "index")).withColumn("left", F.col("d") - F.col("place"))
    placed = written(placed.select("crowd", "token", "node", "c", "n", "f", "left", (F.col("place") < F.col("probe")).alias("probes"), (F.col("place") < F.col("index")).alias("is_met")), "placed")
    cols = ("node", "c", "n", "f", "left")
    x, y = (placed.where(side).select("crowd", "token", *[F.col(c).alias(f"{c}_{n}") for c in cols]) for n, side in (("x", "probes"), ("y", "is_met")))
    enough = F.least("left_x", "left_y") * (2 * (100 + percent)) >= F.col("f_x") + F.col("f_y")
    able = enough & (F.col("c_x") != F.col("c_y")) & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
    on = (F.col("x.crowd") == F.col("y.crowd")) & (F.col("x.token") == F.col("y.token")) & able
    pairs = x.alias("x").join(y.alias("y"), on).select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y")).distinct()
    return links, written(pairs, "pairs", slim=True)


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links; ``labels`` has the nodes that were linked before."""
    if labels is None:
        return written(components(links), "labels", slim=True)
    x, y = (labels.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in "xy")
    between = links.join(x, "x", "left").join(y, "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
    tops = written(components(between), "tops", slim=True)
    up = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(moved.unionByName(tops.select("node", "component")).groupBy("node").agg(F.min("component").alias("component")), "labels", slim=True)


def _across(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (x, y) of ``left`` (key, node, c) and ``right`` (key, other, d) in different components."""
    met = left.join(right, "key").where("c <> d")
    return met.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct()


def linked_classes(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with others. ``reps`` has node, a, b, n and registers, one row for each class."""
    bands = reps.select("node", F.explode(band_keys(F.col("registers"))).alias("key"))
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("least")).where("many > 1").select("key", "least"), "shared")
    members = written(bands.join(shared, "key"), "buckets")
    # all that follows is about classes that share a bucket
    met = written(reps.join(members.select("node").distinct(), "node"), "met")
    sets = full_sets(docs, met, size)
    made = [shared, members, met, sets]

    def linked(pairs: DataFrame) -> DataFrame:
        able = written(likely(pairs, met, percent), "likely", slim=True)
        out = written(confirmed(able, sets, percent), "links", slim=True)
        drop(able)
        made.append(out)
        return out

    def mixed() -> DataFrame:
        """(key, node, c, many, least, drawn) of buckets with several components."""
        named = written(members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "named", slim=True)
        keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.xxhash64("key", "node")).alias("drawn"), F.count(F.lit(1)).alias("many"), F.min("node").alias("least"))
        keys = written(keys.where("lo < hi").drop("lo", "hi"), "mixed", slim=True)
        out = written(named.join(keys, "key"), "there", slim=True)
        drop(named, keys)
        made.append(out)
        return out

    # 1: the least of a bucket, of which the one that is met most
    often = members.where("node <> least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("many"))
    first = often.groupBy("node").agg(F.max(F.struct("many", (-F.col("least")).alias("least"))).alias("best"))
    labels = _merged(None, linked(first.select((-F.col("best.least")).alias("x"), F.col("node").alias("y"))))
    # 2: one that is drawn
    there = mixed()
    if not there.isEmpty():
        lead = there.where(F.xxhash64("key", "node") == F.col("drawn")).select("key", F.col("node").alias("other"), F.col("c").alias("d"))
        labels = _merged(labels, linked(_across(there.select("key", "node", "c"), written(lead, "drawn", slim=True))))
        # 3: all that are left
        there = mixed()
        few = there.where(F.col("many") <= FEW).select("key", "node", "c")
        pairs = _across(few, few.select("key", F.col("node").alias("other"), F.col("c").alias("d")))
        many = there.where(F.col("many") > FEW)
        if many.isEmpty():
            labels = _merged(labels, linked(pairs))
        else:
            links, more = crowded(many, sets, percent)
            labels = _merged(labels, linked(pairs.unionByName(more).distinct()).unionByName(links))
    drop(*made)
    return labels


def classes(docs: DataFrame, size: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b, id, n, digest) of ``docs`` (a, b, id, t), and for each digest its group's ``first``: the row (z, id, a, b) with the least id, nulls last, and the hashes of the row."""
    signed = written(signatures(docs, size), "sketches")
    head = F.struct(F.col("id").isNull().alias("z"), "id", "a", "b")
    # equal sets have equal registers
    ones = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min(head).alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    ones = written(ones.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = ones.select("node", F.col("first.a").alias("a"), F.col("first.b").alias("b"), "n", "registers")
    labels = linked_classes(reps, docs, size, percent)
    tops = ones.join(labels, "node").groupBy("component").agg(F.min("first").alias("top"))
    named = ones.join(labels.join(tops, "component").select("node", "top"), "node", "left")
    return signed.drop("registers"), named.select("digest", F.coalesce("top", "first").alias("first"))


def group(docs: DataFrame, size: int, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: a, b, id, n_shingles and ``first``, the group's row with the least id (null for an empty set)."""
    a, b = row_key(id_col, text)
    rows = docs.select(a.alias("a"), b.alias("b"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("t"))
    signed, firsts = classes(rows, size, percent)
    return signed.join(written(firsts, "firsts"), "digest", "left").select("a", "b", "id", F.col("n").alias("n_shingles"), "first")


def label(docs: DataFrame, size: int, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the id, n_shingles, component_id (the least id that is reachable) and kept. Of a group without ids one row's text is kept."""
    got = group(docs, size, percent, id_col, text)
    alone = F.col("first").isNull()
    is_first = F.when(F.col("id").isNotNull(), F.col("id") == F.col("first.id")).otherwise((F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b")))
    return got.select(F.col("id").alias(id_col), "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"), (alone | F.coalesce(is_first, F.lit(False))).alias("kept"))


def keep(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with the columns of ``docs``; rows without words all stay."""
    first = (F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b"))
    got = group(docs, size, percent).where(F.col("first").isNull() | first).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("first").isNull().alias("_empty")).distinct()
    a, b = row_key("doc_id", "text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), a.alias("_a"), b.alias("_b"))
    both = packed.join(got, ["_a", "_b"])
    one = both.where("NOT _empty").dropDuplicates(["_a", "_b"])
    return one.unionByName(both.where("_empty")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2)


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * shared >= {PERCENT} * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, d.doc_id <= coalesce(least, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.x"""
