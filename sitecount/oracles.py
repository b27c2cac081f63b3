"""DuckDB SQL with the rows of the registered queries, written without looking at the plans: window functions instead of packed aggregates."""

from __future__ import annotations

READS = """
reads AS (SELECT *, 'c' || cid AS contig, 65 AS u FROM (
  SELECT event_id AS rid, event_id // 2 AS frag, event_id % 2 AS mate, (event_id // 2) % 4 AS cid, ((event_id // 2) * 37) % 400 + (event_id % 2) * ((event_id // 2) % 41) AS pos, (event_id * 13) % 61 AS mapq,
    CASE WHEN (event_id // 2) % 7 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 65 ELSE 129 END + 16 * ((event_id // 2 + event_id % 2) % 2)
      + CASE WHEN event_id % 23 = 0 THEN 1024 ELSE 0 END + CASE WHEN event_id % 29 = 0 THEN 512 ELSE 0 END + CASE WHEN event_id % 31 = 0 THEN 256 ELSE 0 END AS flag,
    CASE WHEN (event_id // 2) % 7 = 0 THEN 'q' || (event_id // 2) || '_' || (event_id % 2) ELSE 'q' || (event_id // 2) END AS qname,
    CASE WHEN event_id % 10 = 9 THEN NULL ELSE event_id % 4 END AS ns, event_id % 3 AS yf, event_id % 6 AS zf, event_id % 5 AS shape,
    (event_id // 2) % 7 <> 0 AS paired, ((event_id // 2) * 37) % 400 + (1 - event_id % 2) * ((event_id // 2) % 41) AS there, (1 - 2 * (event_id % 2)) * ((event_id // 2) % 41 + 30) AS apart
  FROM events)),
ops(shape, kind, q0, r0, len) AS (VALUES (0,0,0,0,30),(1,0,5,0,25),(2,0,0,0,10),(2,1,NULL,10,2),(2,0,10,12,20),(3,0,0,0,10),(3,0,13,10,17),(4,0,0,0,12),(4,2,NULL,12,4),(4,0,12,16,18))"""

_STRAND = "CASE WHEN ((flag & 16) <> 0) <> ((flag & 1) <> 0 AND (flag & 64) = 0) THEN 1 ELSE 0 END"


def ref_index(p: str, cid: str = "cid") -> str:
    return f"(({p}) * 7 + ({p}) // 3 + {cid} * 5) % 4"


def ref_base(p: str, cid: str = "cid") -> str:
    return f"CASE WHEN ({p}) < 0 OR ({p}) >= 500 THEN 'N' ELSE substr('ACGT', ({ref_index(p, cid)} + 1)::INT, 1) END"


def entries(excluded: int = 1796, required: int = 0, strand: str = "both", where: str = "TRUE", cap: int = 0) -> str:
    """CTEs up to ``e``: a row for each position of each read, kind 0 to 3 (base, deletion, skip, fail)."""
    side = {"both": "TRUE", "forward": "s = 0", "reverse": "s = 1"}[strand]
    capped = f"QUALIFY row_number() OVER (PARTITION BY cid, rpos ORDER BY rid) <= {cap}" if cap else ""
    return f"""{READS},
r AS (SELECT *, {_STRAND} AS s, (flag & {required}) = {required} AND (flag & {excluded}) = 0 AS ok FROM reads),
x AS (SELECT r.*, CASE WHEN ok THEN o.kind ELSE 3 END AS kind, o.q0 + k AS qpos, pos + o.r0 + k AS rpos FROM r JOIN ops AS o ON r.shape = o.shape, (SELECT unnest(range(30)) AS k) WHERE k < o.len AND {side}),
e AS (SELECT *, CASE WHEN (rid * 5 + qpos) % 97 = 0 THEN 4 ELSE ({ref_index("rpos")} + CASE WHEN (rid * 7 + qpos * 3) % 11 = 0 THEN 1 ELSE 0 END) % 4 END AS b, (rid * 31 + qpos * 17) % 40 + 2 AS bq,
        {ref_base("rpos")} AS ref, CASE WHEN (flag & 16) <> 0 THEN 30 - qpos ELSE qpos END AS dist5, CASE WHEN (flag & 16) <> 0 THEN qpos ELSE 30 - qpos END AS dist3
      FROM x WHERE rpos < 500 AND ({where}) {capped})"""


def sites(slot: str = "0", site_filter: str = "TRUE", dedup: bool = True, pad: int = 0, place: str = "TRUE", **gates) -> str:
    """CTEs up to ``t``: a row for each position and strand with counts by group and events, that passes ``site_filter``."""
    best = "QUALIFY row_number() OVER (PARTITION BY cid, rpos, qname ORDER BY mapq DESC, (flag & 64) DESC, bq DESC, rid) = 1" if dedup else ""
    counts = ", ".join(f"count(*) FILTER (kind = 0 AND b = {k} AND slot = {g}) AS {'acgtn'[k]}{g}" for k in range(5) for g in range(4))
    totals = ", ".join(f"{x}0 + {x}1 + {x}2 + {x}3 AS {x}" for x in "acgtn")
    motif = " || ".join(ref_base(f"pos + ({d})") for d in range(-pad, pad + 1))
    return f"""{entries(**gates)},
w AS (SELECT *, {slot} AS slot FROM e WHERE kind = 0),
k AS (SELECT cid, rpos, s, b, slot, kind FROM (SELECT * FROM w WHERE slot IS NOT NULL {best}) UNION ALL SELECT cid, rpos, s, NULL, NULL, kind FROM e WHERE kind > 0),
g AS (SELECT cid, rpos AS pos, s, {counts}, count(*) FILTER (kind = 1) AS del, count(*) FILTER (kind = 2) AS ref_skip, count(*) FILTER (kind = 3) AS fail FROM k GROUP BY cid, rpos, s),
h AS (SELECT *, {totals}, 'c' || cid AS contig, {ref_base("pos")} AS ref, {motif} AS motif FROM g),
t AS (SELECT * FROM (SELECT *, a + c + g + t + n AS depth, CASE WHEN s = 1 THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS local FROM h) WHERE ({site_filter}) AND ({place}))"""


_SHOWN = "cid::INT AS tid, contig AS chrom, pos + 1 AS pos"


def composition(events: bool = False, **how) -> str:
    extra = ", 0::BIGINT AS ins, del, ref_skip, fail" if events else ""
    return f"WITH {sites(**how)} SELECT {_SHOWN}, CASE WHEN s = 1 THEN '-' ELSE '+' END AS strand, ref, depth, a, c, g, t, n{extra} FROM t"


def _summed() -> str:
    every = [f"{x}{k}" for x in "acgtn" for k in ("", 0, 1, 2, 3)] + ["del", "ref_skip", "fail", "depth"]
    return "y AS (SELECT cid, contig, pos, ref, motif, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in every) + " FROM t GROUP BY ALL)"


def strandless(events: bool = False, **how) -> str:
    extra = ", 0::BIGINT AS ins, del, ref_skip, fail" if events else ""
    return f"WITH {sites(**how)}, {_summed()} SELECT {_SHOWN}, ref, depth, a, c, g, t, n{extra} FROM y"


def alleles(only: str = "TRUE", shown: str = "", **how) -> str:
    other = {x: f"CASE WHEN ref = '{x.upper()}' THEN 0 ELSE {x} END" for x in "acgt"}
    most = f"greatest({', '.join(other.values())})"
    pick = " ".join(f"WHEN most > 0 AND {o} = most THEN '{x.upper()}'" for x, o in other.items())
    shown = shown or f"{_SHOWN}, ref, depth, ref_count, alt, alt_count"
    return f"""WITH {sites(**how)}, {_summed()}, m AS (SELECT *, {most} AS most FROM y),
z AS (SELECT *, CASE ref WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g WHEN 'T' THEN t ELSE 0 END AS ref_count, CASE {pick} ELSE '.' END AS alt, most::BIGINT AS alt_count FROM m)
SELECT {shown} FROM z WHERE depth > 0 AND ({only})"""


def vcf(**how) -> str:
    line = "contig || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT:AD' || chr(9) || '0/1:' || ref_count || ',' || alt_count"
    return alleles("alt_count > 0", f"cid::INT AS tid, pos + 1 AS pos, {line} AS line", **how)


def template(line: str, only: str = "TRUE", **how) -> str:
    rc = "CASE WHEN s = 1 THEN translate(reverse(motif), 'ACGT', 'TGCA') ELSE motif END"
    return f"WITH {sites(**how)}, v AS (SELECT *, {rc} AS m, CASE WHEN s = 1 THEN '-' ELSE '+' END AS strand FROM t) SELECT cid::INT AS tid, pos, s, {line} AS line FROM v WHERE {only}"
