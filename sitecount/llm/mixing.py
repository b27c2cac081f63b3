"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree. DataFrame functions only.

Tokens available are summed by leaf. A node's capacity is what its leaves hold, times the epochs allowed. From the root down, each
node's budget is split among its children by weight; a child whose capacity is below its share keeps its capacity, and what it
leaves goes to its siblings by weight. As capacities are those of whole subtrees, a shortage is made good among
siblings first and reaches a parent's siblings only where the whole family is short. The split is one formula over
running sums (children sorted by capacity per weight), in whole tokens.

A leaf's budget is then so many full epochs and a rest. Documents of a leaf are ordered by a hash of seed, epoch and id; the rest is
the longest prefix of the next epoch's order that fits. Prefixes are found by two levels of sums: key ranges of about
``RANGE`` documents first, then only within the one range where the budget ends, so that no leaf is sorted as a whole.

Null domain, language or source is a value of its own, ``(none)``; null text has no tokens. Empty documents cost nothing and are
taken with a prefix that reaches them. Repeated rows count separately, and share their place in the order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, written

LEVELS = ("domain", "lang", "source")
#: Documents of a key range, about; rows of a table that may be broadcast.
RANGE, BROADCAST_ROWS = 4096, 50_000
NONE = "(none)"
#: Weights are whole parts, so that sums are exact.
PARTS = 1_000_000

# Parameters of the registered query and the pipeline: part of the corpus to take, epochs, seed and weights (1 for those not named).
SHARE, EPOCHS, SEED = 0.6, 2, 17
WEIGHTS = {"domain": {"d0": 0.5, "d1": 0.3, "d2": 0.2}, "lang": {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}}


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(PARTS)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(round(w * PARTS))).otherwise(out)
    return out.cast("long")


def split_budget(children: DataFrame, family: list[str], level: str) -> DataFrame:
    """``children`` (family columns, level, w, cap, and the family's ``budget``) with ``share``, each child's part of the budget."""
    ratio = F.col("cap") / F.col("w")
    order = Window.partitionBy(*family).orderBy("_r", level)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    fill = (F.col("budget") - before) / left
    out = children.withColumn("_r", ratio).withColumn("_fill", fill)
    top = F.max(F.when(F.col("_fill") < F.col("_r"), F.col("_fill"))).over(Window.partitionBy(*family))
    out = out.withColumn("_top", top)
    share = F.when(F.col("_top").isNull(), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("_top") * F.col("w")).cast("long")))
    return out.withColumn("share", F.greatest(share, F.lit(0).cast("long"))).drop("_r", "_fill", "_top")


def leaf_budgets(leaves: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: dict = WEIGHTS, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves`` (levels, avail, n_docs) with ``budget`` in tokens. Leaves of weight 0 get nothing."""
    df = leaves.withColumn("cap", F.col("avail") * F.lit(epochs).cast("long"))
    live = F.lit(True)
    for level in levels:
        live = live & (_weight(level, weights) > 0)
    df = df.withColumn("cap", F.when(live, F.col("cap")).otherwise(F.lit(0).cast("long")))
    nodes = df.groupBy(levels[0]).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(levels[0], weights)).where("w > 0")
    whole = df.agg(F.floor(F.sum("avail") * F.lit(float(share))).cast("long").alias("budget"))
    nodes = nodes.join(F.broadcast(whole))  # one row
    got = split_budget(nodes, [], levels[0]).select(levels[0], F.col("share").alias("budget"))
    for k in range(1, len(levels)):
        family, level = list(levels[:k]), levels[k]
        children = df.groupBy(*family, level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights)).where("w > 0")
        got = split_budget(children.join(got, family), family, level).select(*family, level, F.col("share").alias("budget"))
    return df.drop("cap").join(got, list(levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def _with_leaves(rows: DataFrame, leaves: DataFrame, few: bool) -> DataFrame:
    """Equi-join on the leaf; broadcast where the leaves were counted to be few, else a shuffled join that AQE splits."""
    return rows.join(F.broadcast(leaves) if few else leaves, list(LEVELS))


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, domain: Column, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict = WEIGHTS) -> DataFrame:
    """Documents taken: doc_id, domain, lang, source, n_tokens, and n_epochs, how many times each is taken."""
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip((domain, F.col("lang"), F.col("source")), LEVELS, strict=True)]
    rows = written(docs.select(F.col("doc_id").alias("id"), *named, n_words(F.col("text")).alias("n")), "tokens")
    leaves = written(leaf_budgets(rows.groupBy(*LEVELS).agg(F.sum("n").alias("avail"), F.count(F.lit(1)).alias("n_docs")), share, epochs, weights), "leaves")
    few = leaves.count() <= BROADCAST_ROWS
    full = F.when(F.col("avail") > 0, F.floor(F.col("budget") / F.col("avail"))).otherwise(0).cast("long")
    leaves = leaves.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("avail")).withColumn("ranges", F.ceil(F.col("n_docs") / RANGE).cast("long"))
    leaves = leaves.select(*LEVELS, "full", "rest", "ranges")
    ordered = _with_leaves(rows, leaves, few).withColumn("key", order_key(F.col("full"), seed))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ordered = ordered.withColumn("range", F.floor(place * F.col("ranges")).cast("long"))
    by_range = ordered.groupBy(*LEVELS, "range", "rest").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
    ends = by_range.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    ends = written(ends.select(*LEVELS, F.col("end.range").alias("end"), F.col("end.before").alias("before")), "ends")
    both = ordered.join(F.broadcast(ends) if few else ends, list(LEVELS), "left")
    sure = both.where(F.col("end").isNull() | (F.col("range") != F.col("end"))).withColumn("more", F.when(F.col("end").isNull() | (F.col("range") < F.col("end")), 1).otherwise(0))
    running = F.sum("n").over(Window.partitionBy(*LEVELS, "range").orderBy("key"))
    last = both.where(F.col("range") == F.col("end")).withColumn("more", F.when(F.col("before") + running <= F.col("rest"), 1).otherwise(0))
    out = sure.unionByName(last)
    return out.select(F.col("id").alias("doc_id"), *LEVELS, F.col("n").alias("n_tokens"), (F.col("full") + F.col("more")).cast("long").alias("n_epochs")).where("n_epochs > 0")


def domain_of(docs: DataFrame) -> Column:
    """A domain for the sources of the test tables, which have none: by the number at the end of the name."""
    return F.concat(F.lit("d"), F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("long") % 3)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, domain_of(docs))


def _sql() -> str:
    def weight(level: str) -> str:
        return f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {round(w * PARTS)}" for n, w in WEIGHTS[level].items()) + f" ELSE {PARTS} END" if level in WEIGHTS else str(PARTS)

    ctes, parent = [], "SELECT CAST(floor(sum(avail) * CAST(%s AS DOUBLE)) AS BIGINT) AS budget FROM leaf" % SHARE  # noqa: UP031
    ctes.append(f"b0 AS ({parent})")
    for k, level in enumerate(LEVELS, 1):
        family = ", ".join(LEVELS[: k - 1])
        cols = ", ".join(LEVELS[:k])
        part = f"PARTITION BY {family}" if family else ""
        join = f"JOIN b{k - 1} USING ({family})" if family else "CROSS JOIN b0"
        ctes.append(f"c{k} AS (SELECT {cols}, sum(avail * {EPOCHS})::BIGINT AS cap, {weight(level)} AS w FROM leaf GROUP BY {cols})")
        ctes.append(f"""f{k} AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS fill,
          cap::DOUBLE / w::DOUBLE AS r FROM c{k} {join} WINDOW o AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level}))""")
        ctes.append(f"t{k} AS (SELECT *, max(CASE WHEN fill < r THEN fill END) OVER ({part}) AS top FROM f{k})")
        ctes.append(f"b{k} AS (SELECT {cols}, CASE WHEN top IS NULL THEN cap ELSE greatest(least(cap, CAST(floor(top * w) AS BIGINT)), 0) END AS budget FROM t{k})")
    levels = ", ".join(LEVELS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 3), '{NONE}') AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
             len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n FROM documents),
leaf AS (SELECT {levels}, sum(n)::BIGINT AS avail FROM d GROUP BY {levels}),
{", ".join(ctes)},
e AS (SELECT {levels}, CASE WHEN avail > 0 THEN budget // avail ELSE 0 END AS whole, budget - CASE WHEN avail > 0 THEN budget // avail ELSE 0 END * avail AS rest FROM leaf JOIN b{len(LEVELS)} USING ({levels})),
k AS (SELECT d.*, whole, rest, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM d JOIN e USING ({levels})),
s AS (SELECT *, sum(n) OVER (PARTITION BY {levels} ORDER BY key) AS upto FROM k)
SELECT doc_id, {levels}, n AS n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS n_epochs FROM s WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""


ORACLE = _sql()
