"""What a task or a base costs doesn't grow with the table or the length of an expression."""

import random
import re

import pytest
from fixtures import fasta, read, sam
from pyspark.sql import functions as F
from sitecount import derived, queries
from sitecount.api import count_sites, open_reads
from sitecount.functions.compiler import Compiler, Steps
from sitecount.functions.language import parse
from sitecount.operators.tags import alternative_counts
from sitecount.plans import pileup
from sitecount.plans.bases import read_scope
from sitecount.plans.pileup import Config, gated, may_count, sites
from sitecount.sources.fasta import read_reference

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_depth_cap_drops_reads_before_they_are_unnested(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    shapes = [("20M", 20), ("8M4D8M", 16), ("5S15M", 20), ("20M", 9), ("20M", 0)]
    made = []
    for k in range(600):
        cigar, length = rnd.choice(shapes)
        made.append(read(f"r{k // 2}", rnd.choice((0, 16, 1024)), rnd.randrange(6), "".join(rnd.choice("ACGT") for _ in range(length)) or "*", cigar=cigar))
    reads = open_reads(spark, sam(tmp_path / "d.sam", [("chr1", 60)], made))[0]
    config = Config(max_depth=3)
    assert may_count(gated(reads, config), config).where(F.length("seq") >= 16).count() <= 3 * 6 * 4 * 2 < 300
    got = sorted(map(tuple, sites(reads, None, config).collect()))
    monkeypatch.setattr(pileup, "may_count", lambda reads, config: reads)
    assert got == sorted(map(tuple, sites(reads, None, config).collect())) and got


@pytest.mark.parametrize("expression", [
    queries.ROUTER, "(mapq * 3 - bq) // 4 % 5 >= 2 and bq / 2 > 7.25 and -mapq % 7 ~= 0", "log(mapq + 1) > 2 and log(bq, 2) < 5 and pow(bq, 2) > 100",
    "string.format('%s:%05d:%.2f|%x', rname, mapq, bq / 4, 255) == 'c1:00' .. string.format('%03d', mapq) .. ':' .. string.format('%.2f|ff', bq / 4) and bq > 9",
    "string.char(99, 48 + tid) == rname and math.ult(mapq, -1) and not math.ult(-1, mapq) and math.modf(bq / 4) == 5",
])
def test_parts_of_an_expression_are_evaluated_once(spark, expression):
    steps = Steps()
    Compiler(read_scope(), lambda t: F.col(f"_tag_{t}"), steps).compile(parse(expression))
    sizes = [len(str(c)) for _, c in steps._reads + steps._bases]
    assert max(sizes) < 2500 and sum(sizes) < 60 * len(expression) + 6000


def test_only_what_needs_a_base_is_evaluated_for_it(spark):
    steps = Steps()
    Compiler(read_scope(), lambda t: F.col(f"_tag_{t}"), steps).compile(parse("log(mapq + 1) > 2 and [NS] <= 2 and bq > mapq * 2"))
    text = " ".join(str(c) for _, c in steps._bases)
    assert "_tag_NS" not in text and "LN" not in text.upper().replace("QLEN", "") and "mapq" not in text


def test_whole_numbers_wrap_around(spark, tmp_path):
    reads = sam(tmp_path / "w.sam", [("chr1", 60)], [read("a", 0, 5, "ACGT", tags={"NS": 3}), read("b", 0, 5, "ACGT", tags={"NS": 4})])
    reference = fasta(tmp_path / "w.fa", [("chr1", "A" * 60)])
    for expression in ("mapq * 9223372036854775807 == -60", "[NS] + 9223372036854775807 == -9223372036854775806 and bq > 1", "[NS] == 4 and mapq > 0 or [NS] * 9223372036854775807 > 9"):
        depth = sum(r.a0 for r in count_sites(spark, reads, reference, Config(read_filter=expression)).where("pos = 5").collect())
        assert depth == (1 if "[NS] +" in expression else 2), expression


def test_reference_is_joined_by_stretch(spark, tmp_path):
    rnd = random.Random(4)
    letters = "".join(rnd.choice("ACGT") for _ in range(40_000))
    made = [read(f"r{k}", rnd.choice((0, 16)), rnd.choice((16_340, 16_384, 32_700, 39_950)) - rnd.randrange(60), "".join(rnd.choice("ACGT") for _ in range(100)), cigar=rnd.choice(("100M", "40M200D60M", "50M17000N50M"))) for k in range(60)]
    reads = open_reads(spark, sam(tmp_path / "s.sam", [("chr1", 40_000)], made))[0]
    df = alternative_counts(reads, read_reference(spark, fasta(tmp_path / "s.fa", [("chr1", letters)])), "C", "T")
    expected = []
    for _, flag, _, pos, _, cigar, seq, *_ in made:
        at, q, kept, changed = pos, 0, 0, 0
        for n, op in re.findall(r"(\d+)(.)", cigar):
            for k in range(int(n) if op == "M" else 0):
                pair = (letters[at + k], seq[q + k]) if at + k < len(letters) else ("", "")
                kept += pair == (("G", "G") if flag else ("C", "C"))
                changed += pair == (("G", "A") if flag else ("C", "T"))
            at, q = at + int(n), q + (int(n) if op == "M" else 0)
        expected += [(kept, changed)] if kept + changed else []
    assert sorted((r.alt_ref, r.alt_mut) for r in df.collect()) == sorted(expected)
    assert plan(df).index("posexplode") < plan(df).index("Join Inner")


def test_reads_of_a_task_are_bounded_and_made_after_the_spread(spark, monkeypatch):
    monkeypatch.setattr(derived, "PART", 100)
    n = -(-spark.read.parquet(f"{DATA}/events.parquet").count() // 100)
    assert n > 4 and derived.parts(spark, DATA) == n and derived.reads(spark, DATA).rdd.getNumPartitions() == n
    for name in ("alt_tags_noref", "alt_tags_region", "flag_keep_all", "allele_table"):
        text = plan(queries.QUERIES[name](spark, DATA))
        below = text[text.rindex("RepartitionByExpression") :].split("Relation")[0]
        assert below.count("\n") and "substring" not in below and "aggregate" not in below, name
    assert f", {n}" in plan(queries.QUERIES["flag_keep_all"](spark, DATA))


@pytest.mark.parametrize("name", ["allele_table", "flag_keep_all", "router_two_group", "expr_logs", "expr_ref_mismatch", "dedup_winner", "legacy_tiers"])
def test_bases_of_a_name_are_not_shuffled(spark, name):
    text = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    spread = re.findall(r"Exchange \w+\((.*?)\)", text)
    assert spread and not any("name#" in keys for keys in spread) and "direct_shuffle_partition_id" in text


def test_names_are_resolved_at_home_as_without_one(spark, tmp_path):
    rnd = random.Random(5)
    made = [read(f"r{rnd.randrange(60)}", rnd.choice((0, 16, 65, 129, 1024)), rnd.randrange(12), "".join(rnd.choice("ACGTN") for _ in range(16)), mapq=rnd.randrange(3) * 20, cigar=rnd.choice(("16M", "8M4D8M", "4S12M"))) for _ in range(300)]
    reads = open_reads(spark, sam(tmp_path / "n.sam", [("chr1", 60)], made))[0]
    for config in (Config(), Config(excluded=0), Config(read_filter="bq >= 20 and mapq > 10 or base == 'A'"), Config(max_depth=4)):
        rows = [sorted(map(tuple, sites(reads, None, config, parts).collect())) for parts in (None, 1, 7)]
        assert rows[0] and rows[0] == rows[1] == rows[2], config


def test_fields_of_a_format_are_evaluated_once_and_by_read_where_they_can_be(spark):
    steps = Steps()
    Compiler(read_scope(), lambda t: F.col(f"_tag_{t}"), steps).compile(parse("string.format('%s:%05d:%.2f|%x', rname, mapq, bq / 4, 255) == string.format('%.2f|%05d', bq / 4, mapq) and bq > 9"))
    once = lambda columns, field: sum(field in str(c) for _, c in columns)
    assert (once(steps._bases, "%.2f"), once(steps._reads, "%.2f")) == (1, 0)
    assert (once(steps._bases, "%05d"), once(steps._reads, "%05d")) == (0, 1)
