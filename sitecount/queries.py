"""The registered queries: the engine over the derived alignment view, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived, oracles
from .operators import legacy, tags
from .plans import emit
from .plans.pileup import Config, gated, routed, site_table, winners, with_rivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROUTER = "([NS] <= 2) and (([Yf] >= 1 and [Zf] <= 3 and bq >= 20 and qpos >= 2 and qlen - qpos > 2) and 1 or 0)"
ROUTER_SQL = "CASE WHEN ns <= 2 THEN CASE WHEN yf >= 1 AND zf <= 3 AND bq >= 20 AND qpos >= 2 AND 30 - qpos > 2 THEN 1 ELSE 0 END END"


def table(spark: SparkSession, sf_dir: str, config: Config, **sets) -> DataFrame:
    return site_table(derived.reads(spark, sf_dir), derived.reference(spark), config, parts=derived.parts(spark, sf_dir), **sets)


def register(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def counted(name: str, config: Config, form: Callable = emit.composition, oracle: Callable = oracles.composition, events: bool = False, **sql) -> None:
    extra = {"events": True} if events else {}
    register(name, lambda spark, d: form(table(spark, d, config), **extra), oracle(**extra, **sql))


counted("composition", Config())
counted("composition_strandless", Config(), emit.strandless, oracles.strandless)
counted("composition_indels", Config(), events=True)
counted("composition_zero_depth", Config(read_filter="mapq == 60", site_filter="depth == 0 and fail + del + ref_skip > 0"), events=True, slot="CASE WHEN mapq = 60 THEN 0 END", site_filter="depth = 0 AND fail + del + ref_skip > 0")
counted("strandless_indels", Config(), emit.strandless, oracles.strandless, events=True)
counted("no_dedup_depth", Config(dedup=False), dedup=False)
counted("flag_required", Config(required=65), required=65)
counted("flag_excluded", Config(excluded=16), excluded=16)
counted("flag_keep_all", Config(excluded=0), excluded=0)
counted("strand_forward", Config(strand="forward"), strand="forward")
counted("strand_reverse", Config(strand="reverse"), strand="reverse")
counted("region_window", Config(region=("c1", 99, 250)), place="cid = 1 AND pos >= 99 AND pos < 250")
counted("depth_cap", Config(max_depth=5), cap=5)

# read filters: (name, expression, SQL for the group, null to drop)
_WHEN = "CASE WHEN {} THEN 0 END"
_CIGAR = "list_value(0, 5, 0, 0, 0)[shape + 1]"
for _name, _expression, _sql in (
    ("expr_mapq", "mapq >= 20", "mapq >= 20"),
    ("expr_bq", "bq >= 20", "bq >= 20"),
    ("expr_dist", "dist5 >= 3 and dist3 > 4", "dist5 >= 3 AND dist3 > 4"),
    ("expr_qpos_trim", "qpos >= 2 && qlen - qpos > 2", "qpos >= 2 AND 30 - qpos > 2"),
    ("expr_flag_bits", "flag.reverse == 0 and flag.read1 != 0", "(flag & 16) = 0 AND (flag & 64) <> 0"),
    ("expr_bitmask_const", "flags & (PAIRED | REVERSE) == 17 or flags >> 4 == 0", "(flag & 17) = 17 OR (flag >> 4) = 0"),
    ("expr_tag_missing_drop", "[NS] <= 1", "ns <= 1"),
    ("expr_tag_exists_guard", "exists([NS]) and [NS] >= 2", "ns IS NOT NULL AND ns >= 2"),
    ("expr_tag_or_error", "[NS] <= 1 or mapq > 30", "ns IS NOT NULL AND (ns <= 1 OR mapq > 30)"),
    ("expr_tag_equal_nil", "[NS] ~= 1 and tag('XX') == nil", "ns IS NULL OR ns <> 1"),
    ("expr_regex_rname", "rname =~ '^c[02]$'", "contig IN ('c0', 'c2')"),
    ("expr_regex_not", "qname !~ '[[:digit:]]_1$' and mapq > 3", "NOT (qname LIKE '%_\\_1' ESCAPE '\\') AND mapq > 3"),
    ("expr_cigar_stats", "sclen + n_indel * 2 + ncigar + rlen + (endpos - pos) - soft_clips_5_prime > 64",
     "list_value(0, 5, 0, 0, 0)[shape + 1] + 2 * list_value(0, 0, 1, 1, 0)[shape + 1] + list_value(1, 2, 3, 3, 3)[shape + 1] + 2 * list_value(30, 25, 32, 27, 34)[shape + 1] + 1 - 1 + list_value(1, 1, 1, 1, 1)[shape + 1] - list_value(0, 5, 0, 0, 0)[shape + 1] > 64"),
    ("expr_qual_stats", "smin(qual) <= 3 and smax(qual) >= 40 and slen(seq) == 30 and avg(qual) > 20.5",
     "list_min(list_transform(range(30), lambda q: (rid * 31 + q * 17) % 40 + 2)) <= 3 AND list_max(list_transform(range(30), lambda q: (rid * 31 + q * 17) % 40 + 2)) >= 40 AND list_sum(list_transform(range(30), lambda q: (rid * 31 + q * 17) % 40 + 2)) / 30.0 > 20.5"),
    ("expr_seq_nprop", "n5(20) == 0 and n3(12) * 30 < 1 and #seq == length", "list_sum(list_transform(list_concat(range(20), range(18, 30)), lambda q: CASE WHEN (rid * 5 + q) % 97 = 0 THEN 1 ELSE 0 END)) = 0"),
    ("expr_mate", "mtid == tid and mrname == rname and mpos > pos and tlen >= 40 or is_paired == 0 and mtid < 0", "(paired AND there > pos AND apart >= 40) OR NOT paired"),
    ("expr_sides", "is_reverse + r1 * 2 + r2 * 4 + is_paired >= 4 and library == ''", "CASE WHEN (flag & 16) <> 0 THEN 1 ELSE 0 END + CASE WHEN paired THEN CASE WHEN mate = 0 THEN 3 ELSE 5 END ELSE 0 END >= 4"),
    ("expr_logs", "log(mapq + 1) > 2 and log(bq, 2) < 5 and pow(bq, 2) > 100", "ln(mapq + 1) > 2 AND ln(bq) / ln(2) < 5 AND bq * bq > 100"),
    ("expr_unreadable", "base == 'N' or bq > 38", "b = 4 OR bq > 38"),
    ("expr_arith", "(mapq * 3 - bq) // 4 % 5 >= 2 and bq / 2 > 7.25 and -mapq % 7 ~= 0", "(((floor((mapq * 3 - bq) / 4.0)::BIGINT % 5) + 5) % 5) >= 2 AND bq / 2.0 > 7.25 AND (mapq % 7) <> 0"),
    ("expr_math", "sqrt(mapq) > 4 and round(bq / 4) >= 5 and int(mapq / 7) ~= 3 and math.max(bq, mapq) >= 30 and exp(0) == 1", "sqrt(mapq) > 4 AND floor(bq / 4.0 + 0.5) >= 5 AND trunc(mapq / 7.0) <> 3 AND greatest(bq, mapq) >= 30"),
    ("expr_base_strand", "base == 'A' or base == 'G'", "CASE WHEN s = 1 THEN b IN (3, 1) ELSE b IN (0, 2) END"),
    ("expr_ref_mismatch", "ref == 'A' and strand > 0 or base ~= ref and strand < 0", "(ref = 'A' AND s = 0) OR (s = 1 AND substr('TGCA', (b + 1)::INT, 1) <> ref)"),
    ("expr_strings", "string.upper(rname) .. '/' .. mapq == 'C1/' .. tostring(mapq) or string.sub(qname, -1) == '3'", "cid = 1 OR right(qname, 1) = '3'"),
    ("expr_find", "string.find(rname, '^c[02]') ~= nil and (string.find(qname, '[1-4]', 3) or 9) < 5 or string.find(qname, '_', 1, true) == 4",
     "(cid IN (0, 2) AND regexp_matches(qname, '^..[^1-4]{0,1}[1-4]')) OR strpos(qname, '_') = 4"),
    ("expr_match", "tonumber(string.match(qname, '^q(%d+)')) % 3 == 1 and string.match(qname, '%a_') == nil", "frag % 3 = 1"),
    ("expr_gsub", "string.gsub(qname, '(%d)%d*', '<%1>') == 'q<1>' or string.gsub(rname, 'c', 'chr') == 'chr2'", "regexp_matches(qname, '^q1[0-9]*$') OR cid = 2"),
    ("expr_format", "string.format('%s:%05d:%.2f|%x', rname, mapq, bq / 4, 255) == 'c1:00' .. string.format('%03d', mapq) .. ':' .. string.format('%.2f|ff', bq / 4) and bq > 9", "cid = 1 AND bq > 9"),
    ("expr_char_ult", "string.char(99, 48 + tid) == rname and math.ult(mapq, -1) and not math.ult(-1, mapq) and math.modf(bq / 4) == 5", "bq // 4 = 5"),
    ("expr_not_precedence", "not (mapq >= 20) or !(bq < 10)", "mapq < 20 OR bq >= 10"),
    ("expr_float_router", "mapq / 4", "TRUE_FLOAT"),
):
    _group = "CASE WHEN mapq % 4 <> 0 THEN 0 WHEN mapq // 4 < 4 THEN mapq // 4 END" if _sql == "TRUE_FLOAT" else _WHEN.format(_sql)
    counted(_name, Config(read_filter=_expression), slot=_group)

_SLOT_LINE = "{chrom}\\t{pos}\\t{strand}\\t{a.0},{a.1},{c.0},{c.1},{g.0},{g.1},{t.2},{t.3}"
_SLOT_SQL = "contig || chr(9) || pos || chr(9) || strand || chr(9) || a0 || ',' || a1 || ',' || c0 || ',' || c1 || ',' || g0 || ',' || g1 || ',' || t2 || ',' || t3"


def templated(name: str, line: str, sql: str | None, config: Config = Config(), target: str | None = None, only: str = "TRUE", **how) -> None:
    register(name, lambda spark, d: emit.by_template(table(spark, d, config), line, target_base=target), None if sql is None else oracles.template(sql, only, **how))


templated("router_two_group", _SLOT_LINE, _SLOT_SQL, Config(read_filter=ROUTER), slot=ROUTER_SQL)
templated("router_four_group", _SLOT_LINE, _SLOT_SQL, Config(read_filter="mapq % 4"), slot="mapq % 4")
templated("router_bool_compat", _SLOT_LINE, _SLOT_SQL, Config(read_filter="bq >= 30"), slot="CASE WHEN bq >= 30 THEN 0 END")
templated("router_drop", _SLOT_LINE, _SLOT_SQL, Config(read_filter="mapq >= 50 and 7 or bq % 4"), slot="CASE WHEN mapq >= 50 THEN NULL ELSE bq % 4 END")

counted("site_depth_min", Config(site_filter="depth >= 12"), site_filter="depth >= 12")
counted("site_alt_min", Config(site_filter="ref == 'A' and (c + g + t) > 0"), site_filter="ref = 'A' AND c + g + t > 0")
counted("site_base_strand", Config(site_filter="base == 'T' and strand == '-'"), site_filter="local = 'T' AND s = 1")
counted("site_motif", Config(site_filter="motif =~ '^[AC].[GT]'", motif_pad=1), site_filter="regexp_matches(motif, '^[AC].[GT]')", pad=1)
counted("strandless_site_filter", Config(site_filter="depth >= 12"), emit.strandless, oracles.strandless, site_filter="depth >= 12")
counted("best_alt", Config(), emit.alleles, oracles.alleles)
counted("allele_table", Config(site_filter="depth >= 5", excluded=0), emit.alleles, oracles.alleles, site_filter="depth >= 5", excluded=0)
counted("vcf_lines", Config(), emit.vcf, oracles.vcf)

templated("target_base", "{chrom}:{pos}{strand}\\t{base}\\t{depth}", "contig || ':' || pos || strand || chr(9) || local || chr(9) || depth", target="C", only="local = 'C'")
templated("motif_revcomp", "{pos}\\t{strand_code}\\t{motif}", "pos || chr(9) || CASE WHEN s = 1 THEN -1 ELSE 1 END || chr(9) || m", Config(motif_pad=3), pad=3)
templated("template_slots", "{{x}\\t{a.0}\\t{n.3}\\t{ins}", "'{x}' || chr(9) || a0 || chr(9) || n3 || chr(9) || 0")
templated("template_nil_cell", "{pos}|{u}|{depth > 9}|{strand == '+' and 'p' or 'm'}", "pos || '||' || CASE WHEN depth > 9 THEN 'true' ELSE '' END || '|' || CASE WHEN s = 0 THEN 'p' ELSE 'm' END")
templated("template_ratio", "{chrom}\\t{pos}\\t{round(t / (c + t + 1), 2)}\\t{a + g}", "contig || chr(9) || pos || chr(9) || CASE WHEN r = floor(r) THEN printf('%.1f', r) ELSE rtrim(printf('%.2f', r), '0') END || chr(9) || (a + g)".replace("r = ", "(floor(t / (c + t + 1.0)::DOUBLE * 100 + 0.5) / 100) = ").replace("floor(r)", "floor(floor(t / (c + t + 1.0)::DOUBLE * 100 + 0.5) / 100)").replace(", r)", ", floor(t / (c + t + 1.0)::DOUBLE * 100 + 0.5) / 100)"))
_FLOAT = "regexp_replace(printf('%.14g', {}), '^(-?[0-9]+)$', '\\1.0')"
templated("template_float_text", "{pos}\\t{depth / 3}\\t{sqrt(depth)}\\t{2 ^ depth}", " || chr(9) || ".join(["pos", *map(_FLOAT.format, ("depth / 3.0::DOUBLE", "sqrt(depth)", "pow(2.0::DOUBLE, depth)"))]))


def _dedup_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routed(with_rivals(gated(derived.reads(spark, sf_dir), Config()), derived.parts(spark, sf_dir)), None, Config())
    n = F.col("n")
    return winners(rows).where("code < 64").groupBy("contig", F.col("rpos").cast("long").alias("pos")).agg(F.sum(n).alias("winners"), F.sum(F.col("code").bitwiseAND(1) * n).alias("minus"), F.sum(F.shiftright("code", 1) * n).alias("base_sum"))


register("dedup_winner", _dedup_winner, f"""WITH {oracles.entries()}, w AS (SELECT * FROM e WHERE kind = 0 QUALIFY row_number() OVER (PARTITION BY cid, rpos, qname ORDER BY mapq DESC, (flag & 64) DESC, bq DESC, rid) = 1)
SELECT contig, rpos AS pos, count(*) AS winners, sum(s)::BIGINT AS minus, sum(b)::BIGINT AS base_sum FROM w GROUP BY ALL""")  # fmt: skip

# interval sets: (contig, start, end)
INTERVALS = (("c0", 10, 60), ("c1", 0, 5), ("c1", 200, 201), ("c2", 490, 700), ("c0", 50, 90), ("c3", 7, 7))
POINTS = (("c0", 33, 34), ("c3", 100, 101), ("c3", 101, 102))


def _intervals(spark: SparkSession, rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "contig string, start int, end int")


def _set_sql(rows: tuple, keep: bool) -> str:
    test = " OR ".join(f"(cid = {c[1]} AND pos >= {a} AND pos < {b})" for c, a, b in rows)
    return test if keep else f"NOT ({test})"


register("bed_include", lambda spark, d: emit.composition(table(spark, d, Config(), include=_intervals(spark, INTERVALS))), oracles.composition(place=_set_sql(INTERVALS, True)))
register("bed_exclude", lambda spark, d: emit.composition(table(spark, d, Config(), exclude=_intervals(spark, INTERVALS))), oracles.composition(place=_set_sql(INTERVALS, False)))
register("bed_points", lambda spark, d: emit.composition(table(spark, d, Config(), include=_intervals(spark, POINTS))), oracles.composition(place=_set_sql(POINTS, True)))


def _mutation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.mutation_rate(table(spark, sf_dir, Config()), "A", "G")


_U, _M = "CASE WHEN s = 1 THEN t ELSE a END", "CASE WHEN s = 1 THEN c ELSE g END"
register("mutation_rate", _mutation_rate, f"""WITH {oracles.sites()} SELECT contig AS chrom, pos + 1 AS pos, CASE WHEN s = 1 THEN '-' ELSE '+' END AS strand, {_U} AS u, {_M} AS m, depth - ({_U}) - ({_M}) AS o,
CASE WHEN ({_U}) + ({_M}) = 0 THEN NULL ELSE ({_M})::DOUBLE / (({_U}) + ({_M})) END AS mutation_rate FROM t WHERE local = 'A'""")  # fmt: skip


# conversion tiers and tags
_LEGACY_OK = "flag & 1284 = 0 AND ns <= 1 AND zf <= 3 AND yf >= 1"
_LOCAL = "CASE WHEN s = 1 THEN substr('TGCA', (b + 1)::INT, 1) ELSE substr('ACGT', (b + 1)::INT, 1) END"


def _tier_sql(shown: str, pad: int = 15) -> str:
    motif = " || ".join(oracles.ref_base(f"pos + ({d})") for d in range(-pad, pad + 1))
    return f"""WITH {oracles.entries(excluded=0)},
w AS (SELECT *, {_LOCAL} AS letter FROM e WHERE kind = 0 AND {_LEGACY_OK} AND qpos >= 2 AND 30 - qpos > 2 AND bq >= 20 QUALIFY row_number() OVER (PARTITION BY cid, rpos, qname ORDER BY bq DESC, rid) = 1),
g AS (SELECT contig, cid, rpos AS pos, s, ref, count(*) FILTER (letter = 'A') AS u1, count(*) FILTER (letter = 'G') AS m1, count(*) FILTER (letter NOT IN ('A', 'G')) AS o1 FROM w WHERE ref = 'A' GROUP BY ALL),
h AS (SELECT *, {motif} AS forward FROM g WHERE u1 + m1 > 0),
v AS (SELECT contig AS chrom, pos + 1 AS pos, CASE WHEN s = 1 THEN '-' ELSE '+' END AS strand, CASE WHEN s = 1 THEN translate(reverse(forward), 'ACGT', 'TGCA') ELSE forward END AS motif,
  0::BIGINT AS u0, u1, 0::BIGINT AS u2, 0::BIGINT AS m0, m1, 0::BIGINT AS m2, 0::BIGINT AS o0, o1, 0::BIGINT AS o2, m1::DOUBLE / (u1 + m1) AS mutation_rate FROM h)
SELECT {shown} FROM v"""


def _tiers(save_rest: bool) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return legacy.tiers(derived.reads(spark, sf_dir), derived.reference(spark), parts=derived.parts(spark, sf_dir)).select(*legacy.headers(save_rest))

    return run


for _name, _rest in (("legacy_tiers", False), ("legacy_save_rest", True)):
    register(_name, _tiers(_rest), _tier_sql(", ".join(legacy.headers(_rest))))
register(
    "legacy_skip_counters",
    lambda spark, d: legacy.skip_counters(derived.reads(spark, d), legacy.Tiers(strand="forward", min_mapq=5)),
    f"""WITH {oracles.READS}, r AS (SELECT *, {oracles._STRAND} AS s FROM reads), y AS (SELECT CASE WHEN s <> 0 THEN 'wrong_strand' WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 256 <> 0 THEN 'secondary'
      WHEN mapq < 5 THEN 'low_mapq' WHEN ns IS NULL THEN 'missing_tags' WHEN ns > 1 THEN 'mismatches' WHEN NOT (zf <= 3 AND yf >= 1) THEN 'conversion' END AS why FROM r)
SELECT count(*) AS total_reads, count(*) FILTER (why IS NULL) AS used, """
    + ", ".join(f"count(*) FILTER (why = '{w}') AS {w}" for w in ("wrong_strand", "unmapped", "duplicate", "secondary", "low_mapq", "missing_tags", "mismatches", "conversion", "no_sequence"))
    + " FROM y",
)

REGION = ("c2", 100, 300)
_ALT = f"""{{entries}}, a AS (SELECT rid, count(*) FILTER (letter = 'C') AS alt_ref, count(*) FILTER (letter = 'T') AS alt_mut FROM (SELECT *, {_LOCAL} AS letter FROM e WHERE kind = 0 AND ({{only}})) WHERE letter IN ('C', 'T') GROUP BY rid)"""
_BY_REGION = _ALT.format(entries=oracles.entries(excluded=0), only="cid = 2 AND rpos >= 100 AND rpos < 300 AND CASE WHEN s = 1 THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END = 'C'")
_BY_BASE = _ALT.format(entries=oracles.entries(excluded=0), only="qpos >= 2 AND 30 - qpos > 2 AND bq >= 20")


def _by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.alternative_counts(derived.reads(spark, sf_dir), derived.reference(spark), "C", "T", REGION)


def _by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.alternative_counts_by_base(derived.reads(spark, sf_dir), "C", "T")


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived.reads(spark, sf_dir)
    out = tags.tagged(reads, _by_base(spark, sf_dir), swapped=True)
    value = lambda t: F.try_element_at("tags", F.lit(t))["i"].alias(t.lower())
    return out.select("ord", F.coalesce(value("NS"), F.lit(-1)).alias("ns"), value("Yc"), value("Zc"))


register("alt_tags_region", _by_region, f"WITH {_BY_REGION} SELECT rid AS ord, alt_ref, alt_mut FROM a")
register("alt_tags_noref", _by_base, f"WITH {_BY_BASE} SELECT rid AS ord, alt_ref, alt_mut FROM a")
register("ns_adjust", _adjusted, f"WITH {_BY_BASE} SELECT r.rid AS ord, CASE WHEN ns IS NOT NULL THEN greatest(ns - coalesce(alt_mut, 0), 0) ELSE -1 END AS ns, coalesce(alt_ref, 0) AS yc, coalesce(alt_mut, 0) AS zc FROM reads AS r LEFT JOIN a ON r.rid = a.rid")
register(
    "tag_stats",
    lambda spark, d: tags.tag_stats(tags.tagged(derived.reads(spark, d), _by_region(spark, d))),
    f"""WITH {_BY_REGION} SELECT count(*) AS total_reads, count(*) AS reads_with_yc, count(*) AS reads_with_zc, sum(coalesce(alt_mut, 0))::BIGINT AS total_yc, sum(coalesce(alt_ref, 0))::BIGINT AS total_zc,
count(*) FILTER (coalesce(alt_mut, 0) > 0 OR coalesce(alt_ref, 0) > 0) AS reads_with_alternatives FROM reads AS r LEFT JOIN a ON r.rid = a.rid""",
)
