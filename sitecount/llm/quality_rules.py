"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``RULES`` names a ratio of counted quantities and the range that it must stay in. ``compile_rules`` turns the table into
one boolean column for each rule; ``score`` adds the counts, the names of the rules that failed and the verdict to each row.
Everything is evaluated within a row: there is no shuffle.

Null text counts as empty; a text without words fails the base rule (fewer than 50 words). A ratio with a denominator of
zero is not judged. Columns of the input that share a name with one that is added are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was it that for with as on by this at from be are an a or "
    "der die das und in zu den von mit ist auf für nicht ein eine sich im dem des als "
    "le la les de des et un une du en que qui pour dans sur par est pas au il "
    "el los las y del se no por con una su para es lo al"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """The ratio ``top / bottom`` of two counts must be within [least, most]; a bound of None isn't tested."""

    name: str
    top: str
    bottom: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.25),
    Rule("mean_word_length", "word_chars", "n_words", least=2.0, most=20.0),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=0.01),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("lines_per_word", "n_lines", "n_words", most=0.5),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def compile_rules(rules: tuple[Rule, ...] = RULES) -> list[tuple[str, Column]]:
    """For each rule, a column that is true where it fails."""
    out = []
    for r in rules:
        top, bottom = F.col(r.top).cast("double"), F.col(r.bottom).cast("double")
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (top < F.lit(float(r.least)) * bottom)
        if r.most is not None:
            bad = bad | (top > F.lit(float(r.most)) * bottom)
        out.append((r.name, (bottom > 0) & bad))
    return out


def _covered(positions: Column, size: int) -> Column:
    """How many positions the windows of ``size`` that start at sorted ``positions`` cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))

    def add(acc, p):
        return F.struct((acc.n + F.lit(size) - F.greatest(acc.end - p, F.lit(0))).cast("int").alias("n"), (p + F.lit(size)).cast("int").alias("end"))

    return F.aggregate(positions, start, add, lambda acc: acc.n)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the counted quantities. Each step is a projection; steps stay apart where a value is used again."""
    t = F.coalesce(F.col(text), F.lit(""))
    mine = {*COUNTS, "n_lines", "n_stop_words", "_w", "_lines", "_tri", "_sorted", "_text"}
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in mine], t.alias("_text"))
    df = df.select(
        "*",
        words(F.col("_text")).alias("_w"),
        F.filter(F.split(F.col("_text"), "\n", -1), lambda line: F.translate(line, " " + SPACES, "") != "").alias("_lines"),
        F.length(F.translate(F.col("_text"), " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).drop("_text")
    n = F.size("_w")
    df = df.select(
        "*",
        n.cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n >= 3, F.transform(F.slice(F.col("_w"), 1, n - 2), lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<string>")).alias("_tri"),
    ).drop("_lines", "_w")
    repeats = F.size(F.array_distinct("_tri")) < F.size("_tri")
    pair = F.transform("_tri", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    none = F.array().cast("array<struct<t:string,i:int>>")
    df = df.select("*", F.when(repeats, F.sort_array(pair)).otherwise(none).alias("_sorted")).drop("_tri")
    same = lambda x, j: F.coalesce(F.get("_sorted", j)["t"] == x["t"], F.lit(False))
    twice = F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return df.select("*", F.when(F.size("_sorted") > 0, _covered(at, 3)).otherwise(0).cast("long").alias("n_repeat_words")).drop("_sorted")


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows with counts, ``base_failed``, ``failed_rules`` (names, comma-joined) and ``kept``; columns of ``docs`` with these names give way to them."""
    df = counts(docs.drop("base_failed", "failed_rules", "kept"), text)
    compiled = compile_rules(rules)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in compiled])
    return df.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_judged"))
    # the place keeps the filter above the projections: pushed below them, it would evaluate the counts again for every element they are used for
    judged = score(packed, rules, text="_judged").select("_row", "kept", F.monotonically_increasing_id().alias("_place"))
    return judged.where(F.col("kept") & (F.col("_place") >= 0)).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).select("doc_id", *COUNTS, "base_failed", "kept", "n_lines", "n_stop_words", "failed_rules")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bad = []
    for r in RULES:
        tests = [f"{r.top} < {r.least} * {r.bottom}"] if r.least is not None else []
        tests += [f"{r.top} > {r.most} * {r.bottom}"] if r.most is not None else []
        bad.append(f"CASE WHEN {r.bottom} > 0 AND ({' OR '.join(tests)}) THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, w, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) ELSE [] END AS g FROM w),
p AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        concat_ws(',', {', '.join(bad)}) AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM f"""


ORACLE = _sql()
