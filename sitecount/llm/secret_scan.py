"""Secret scans: candidates by pattern, judged by how widely their hashes are owned across the corpus. DataFrame functions only.

Candidates are found within each row: ``split`` gives the gaps between matches and ``regexp_extract_all`` the matches, and
running sums of their lengths are the spans, in code points. Each candidate's value is hashed; hashes are counted by distinct
repository and owner, first within (hash, owner, repository), so that a value copied everywhere is pre-aggregated before it
is shuffled. A value that ``SPREAD`` or more owners have is a copied example, and so is one that only two have, but in ``SPREAD_REPOS`` or more
repositories; one that few own and that looks generated is live. The verdicts go back to their spans in an equi-join on the hash, which AQE
splits where a hash is hot. No value is ever written, only hashes.

Null text counts as empty and has no candidates. A null owner or repository counts as one more owner or repository. Repeated
rows get the same result each; a repeated row is one owner's. Columns with clashing names aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# The patterns of the base kinds, in their order.
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"((?i:{KEYWORDS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "live")
LIVE = len(KINDS) - 1
LEAST_ASSIGN = 8
# Parts of placeholders.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "xxxx", "1234567")

#: Owners, and for two owners repositories, from which on a value counts as a copied example; letters that a live value has at least, and different ones.
SPREAD, SPREAD_REPOS, LEAST_LENGTH, LEAST_DIFFERENT = 3, 4, 16, 8

_FOUND = "array<struct<s:int,k:int,e:int,v:string>>"


def _matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """The spans of a pattern's non-overlapping matches whose ``group`` has ``least`` code points, with that group's text."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def add(acc, p):
        s = acc["at"] + F.length(p["g"])
        e = s + F.coalesce(F.length(p["w"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), p["v"].alias("v")))
        return F.struct(e.alias("at"), F.when(p["w"].isNotNull() & (F.length(p["v"]) >= least), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, add, lambda acc: acc["out"])


def candidates(text: Column) -> Column:
    """All candidates of a text as (s, k, e, v): start, kind, end and secret value, by start, then kind. A text without a hint of a kind skips its pattern."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(_FOUND)
    found = (
        F.when(t.rlike(rf"(?i:{KEYWORDS})[\"']?\x20*[:=]"), _matches(t, ASSIGN, 0, 2, LEAST_ASSIGN)).otherwise(none),
        F.when(F.contains(t, F.lit("AKIA")), _matches(t, ACCESS, 1, 0, 16)).otherwise(none),
        F.when(t.rlike("[0-9a-f]{32}"), _matches(t, HEX, 2, 0, 32)).otherwise(none),
    )
    return F.sort_array(F.concat(*found))


def looks_live(value: Column) -> Column:
    """Long, of letters and digits, of many different characters, and no placeholder."""
    low = F.lower(value)
    plain = F.lit(True)
    for p in PLACEHOLDERS:
        plain = plain & ~F.contains(low, F.lit(p))
    return plain & (F.length(value) >= LEAST_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT)


def _is_kind(k: int):
    return lambda x: x["k"] == k


def render(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def ownership(found: DataFrame) -> DataFrame:
    """Docs, repositories and owners by hash: (hash, n_found, n_repos, n_owners). ``found`` has hash, owner and repo."""
    by_place = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_place.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def is_example(n_owners: Column, n_repos: Column) -> Column:
    return (n_owners >= SPREAD) | (n_owners > 1) & (n_repos >= SPREAD_REPOS)


def judged(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scanned rows (a, b, id, found), and for rows with candidates (a, b, live, n_example, n_owners, n_repos): spans of live values, how many are copied examples,
    and how many owners and repositories the most widely held value has.

    a and b tell apart all rows but equal ones.
    """
    ident, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    owned = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((owner, "owner"), (repo, "repo"))]
    hashed = F.transform(
        candidates(t),
        lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), (c["e"] - F.length(c["v"])).alias("from"), F.unhex(F.sha2(c["v"], 256)).alias("hash"), looks_live(c["v"]).alias("lively")),
    )
    rows = written(docs.select(F.xxhash64(ident).alias("a"), F.xxhash64(t, ident.isNull()).alias("b"), ident.alias("id"), *owned, hashed.alias("found")), "secrets")
    each = rows.where(F.size("found") > 0).select("a", "b", "owner", "repo", F.explode("found").alias("c")).select("a", "b", "owner", "repo", "c.hash", "c.lively", F.col("c.from").alias("s"), "c.e")
    owners = written(ownership(each), "owners")  # a plain table, so that AQE can split a hot value in the join
    verdicts = each.select("a", "b", "hash", "lively", "s", "e").join(owners, "hash")
    example = is_example(F.col("n_owners"), F.col("n_repos"))
    live = F.when(F.col("lively") & ~example, F.struct(F.col("s"), F.lit(LIVE).alias("k"), F.col("e")))
    by_row = verdicts.groupBy("a", "b").agg(
        F.sort_array(F.collect_set(live)).alias("live"), F.collect_set(F.when(example, F.struct("s", "e"))).alias("examples"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos")
    )
    return rows, by_row.select("a", "b", "live", F.size("examples").cast("long").alias("n_example"), "n_owners", "n_repos")


def scan(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the id, counts by base kind, base_sha256, spans, n_live and n_example (different spans of each verdict), and n_owners and n_repos of
    the most widely held value (0 for none)."""
    rows, verdicts = judged(docs, owner, repo, id_col, text)
    found = rows.select("a", "b", "id", F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("found"))
    both = found.join(verdicts, ["a", "b"], "left")
    live = F.coalesce("live", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    count = [F.size(F.filter("found", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:LIVE])]
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(
        F.col("id").alias(id_col),
        *count,
        F.sha2(render(F.col("found")), 256).alias("base_sha256"),
        render(F.sort_array(F.concat("found", live))).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        *map(number, ("n_example", "n_owners", "n_repos")),
    )


def without_live(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """The rows of ``docs`` without live secrets, with the columns of ``docs``; copied examples don't count."""
    _, verdicts = judged(docs, owner, repo)
    bad = verdicts.where(F.size("live") > 0).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id").alias("_a"), F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("_b"))
    return packed.join(bad, ["_a", "_b"], "left_anti").select("_row.*")


def places(docs: DataFrame) -> tuple[Column, Column]:
    """Owner and repository of documents: the source, and the source's part in one language."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, *places(docs))


def _sql() -> str:
    assign, parts = ASSIGN.replace("'", "''").replace('\\"', '"'), []
    for k, (pattern, group, least) in enumerate(((assign, 2, LEAST_ASSIGN), (ACCESS, 0, 16), (HEX, 0, 32))):
        parts.append(rf"""
SELECT r, {k} AS k, s[i] AS s, s[i] + length(w[i]) AS e, v[i] AS v FROM (
  SELECT r, w, v, list_transform(range(1, len(w) + 1), lambda j: list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:j - 1], lambda x: length(x))), 0)) AS s, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d))
WHERE length(v[i]) >= {least}""")
    plain = " AND ".join(f"NOT contains(lower(v), '{p}')" for p in PLACEHOLDERS)
    name = f"['{"', '".join(KINDS)}'][k + 1] || ':' || s || ':' || e"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
f AS ({" UNION ALL ".join(parts)}),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM f JOIN d ON f.r = d.r GROUP BY v),
x AS (SELECT f.r, f.e - length(f.v) AS s, f.e, owners, repos, owners >= {SPREAD} OR owners > 1 AND repos >= {SPREAD_REPOS} AS example, {plain.replace("(v)", "(f.v)")} AND length(f.v) >= {LEAST_LENGTH}
        AND regexp_matches(f.v, '[0-9]') AND regexp_matches(f.v, '[A-Za-z]') AND len(list_distinct(string_split(f.v, ''))) >= {LEAST_DIFFERENT} AS lively FROM f JOIN o ON f.v = o.v),
l AS (SELECT DISTINCT r, {LIVE} AS k, s, e FROM x WHERE lively AND NOT example),
b AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({name}, ',' ORDER BY s, k) AS base FROM f GROUP BY r),
a AS (SELECT r, string_agg({name}, ',' ORDER BY s, k, e) AS spans FROM (SELECT r, k, s, e FROM f UNION ALL SELECT r, k, s, e FROM l) GROUP BY r),
n AS (SELECT r, count(*) AS n_live FROM l GROUP BY r),
m AS (SELECT r, count(DISTINCT (s, e)) FILTER (example) AS n_example, max(owners) AS n_owners, max(repos) AS n_repos FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_owners, 0) AS n_owners, coalesce(n_repos, 0) AS n_repos
FROM d LEFT JOIN b ON d.r = b.r LEFT JOIN a ON d.r = a.r LEFT JOIN n ON d.r = n.r LEFT JOIN m ON d.r = m.r"""


ORACLE = _sql()
