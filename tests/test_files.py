"""Golden rows from small files: overlap, strands, indels, routing, formats."""

import gzip

import pytest
from fixtures import bam, fasta, read, sam
from pyspark.sql import functions as F
from sitecount.api import Output, count_sites, format_duration, formatted, open_reads, run, write_parts
from sitecount.cli import main
from sitecount.plans import emit
from sitecount.plans.pileup import Config, site_table
from sitecount.plans.regions import parse_region
from sitecount.schema import ExpressionError, InputError, RegionError
from sitecount.sources.bam import read_bam
from sitecount.sources.fasta import missing_contigs, read_index, read_intervals, read_reference

OVERLAP = [
    read("f1", 99, 5, "A" * 25, mpos=20, tlen=40), read("f1", 147, 20, "A" * 25, mpos=5, tlen=-40), read("f5", 16, 33, "A" * 25),
    read("f2", 0, 55, "G" * 25), read("f4", 0, 60, "A" * 25, mapq=0), read("f3", 0, 70, "C" * 25),
]
ROUTER = "([NS] <= 1) and (([Yf] >= 1 and [Zf] <= 3 and bq >= 20 and qpos >= 2 and qlen - qpos > 2) and 1 or 0)"


def _t(ns, yf):
    return {"NS": ns, "Yf": yf, "Zf": 0}


ROUTED = [read(q, f, p, s, contig="chrT", quality=qu, tags=t) for q, f, p, s, qu, t in (
    ("p_hi", 0, 0, "GGGGAAATT", 40, _t(0, 1)), ("p_lo", 0, 0, "GGGGAAATT", 10, _t(0, 1)), ("p_g", 0, 0, "GGGGGAATT", 40, _t(0, 1)), ("p_x", 0, 0, "GGGGAAATT", 40, _t(2, 1)),
    ("m_hi", 16, 4, "AAAACCCCC", 40, _t(0, 1)), ("m_lo", 16, 4, "AAAACCCCC", 40, _t(0, 0)), ("m_x", 16, 4, "AAAACCCCC", 40, _t(2, 1)))]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    out = {
        "fa": fasta(d / "a.fa", [("chr1", "A" * 80)]),
        "sam": sam(d / "a.sam", [("chr1", 80)], OVERLAP),
        "bam": bam(d / "a.bam", [("chr1", 80)], OVERLAP),
        "t_fa": fasta(d / "t.fa", [("chrT", "ggggAAAACCCC")]),
        "t_bam": bam(d / "t.bam", [("chrT", 12)], ROUTED),
        "i_fa": fasta(d / "i.fa", [("chr1", "ACGT" * 15)]),
        "i_sam": sam(d / "i.sam", [("chr1", 60)], [read("D", 0, 30, "A" * 10, cigar="5M2D5M"), read("S", 0, 30, "A" * 9, cigar="5M3N4M")]),
        "r_sam": sam(d / "r.sam", [("chr1", 60)], [read("f", 0, 0, "ACGTACGTAC"), read("r", 16, 0, "ACGTACGTAC"), read("m", 16, 0, "ATGTACGTAC")]),
    }
    with gzip.open(d / "a.sam.gz", "wt") as f:
        f.write((d / "a.sam").read_text())
    out["gz"] = str(d / "a.sam.gz")
    out["dir"] = d
    return out


def rows(df):
    return sorted(tuple(r) for r in df.drop("tid").collect())


def test_overlap_counts_once_and_formats_agree(spark, files):
    got = [rows(emit.composition(count_sites(spark, files[k], files["fa"]))) for k in ("sam", "gz", "bam")]
    assert got[0] == got[1] == got[2]
    depth = {(r[1], r[2]): r[4] for r in got[0]}
    assert all(depth[p, "+"] == 1 for p in range(6, 46)) and min(p for p, _ in depth) == 6 and max(p for p, _ in depth) == 80
    assert all(depth[p, "-"] == 1 for p in range(34, 59))
    reads, reference = open_reads(spark, files["sam"])[0].withColumn("ord", F.col("ord") + (1 << 40)), read_reference(spark, files["fa"])
    assert rows(emit.composition(site_table(reads, reference, Config()))) == got[0]
    for side, sign in (("forward", "+"), ("reverse", "-")):
        assert {r[2] for r in rows(emit.composition(count_sites(spark, files["sam"], files["fa"], Config(strand=side))))} == {sign}


def test_bam_records_and_partitions(spark, files):
    one, contigs = read_bam(spark, files["bam"])
    many, _ = read_bam(spark, files["bam"], step=60)
    assert many.rdd.getNumPartitions() > 1 and contigs.collect()[0][:] == (0, "chr1", 80)
    key = lambda df: sorted((r.ord, r.qname, r.pos, r.seq, r.mpos, r.tlen, r.tags["XF"].f, r.tags["RG"].s, "XB" in r.tags) for r in df.collect())
    assert key(one) == key(many) and len(key(one)) == len(OVERLAP)
    assert [r.qname for r in one.where("contig = 'chr1' AND pos >= 50 AND pos < 61").orderBy("ord").collect()] == ["f2", "f4"]


def test_bam_ranges_start_at_any_byte(spark, tmp_path):
    """Whatever the ranges, each record is read once, at its place; an index narrows a region down."""
    import random

    rnd = random.Random(5)
    reads = sorted((read(f"r{k}", 0, rnd.randrange(60_000), "".join(rnd.choice("ACGTN") for _ in range(rnd.randrange(1, 400))), contig=rnd.choice(("a", "b")), tags={"NS": k % 7}) for k in range(300)), key=lambda r: (r[2], r[3]))
    path = bam(tmp_path / "x.bam", [("a", 70_000), ("none", 10), ("b", 70_000)], reads, block=511, index=True)
    whole = [tuple(r) for r in read_bam(spark, path)[0].orderBy("ord").select("ord", "qname", "contig", "pos", "seq", "tags").collect()]
    assert [(r[1], r[2], r[3], r[4]) for r in whole] == [(r[0], r[2], r[3], r[6]) for r in reads] and whole[0][5]["XB"].s == "c,1,2"
    for step in (211, 1_000, 9_999):
        assert [tuple(r) for r in read_bam(spark, path, step)[0].orderBy("ord").select("ord", "qname", "contig", "pos", "seq", "tags").collect()] == whole
    for region in (("a", 0, 500), ("b", 30_000, 45_000), ("b", 59_000, 70_000), ("none", 0, 5)):
        got = read_bam(spark, path, 2_000, region)[0].collect()
        touching = {r[0] for r in reads if r[2] == region[0] and r[3] < region[2] and r[3] + len(r[6]) > region[1]}
        assert touching <= {r.qname for r in got} <= {r[0] for r in reads if r[2] == region[0]} and len(got) < 250
        assert (region[1] < 20_000) or len(got) < 120


def test_written_bam_is_sorted_indexed_and_reads_back(spark, tmp_path):
    import random

    from sitecount.api import tag_reads
    from sitecount.sources.bam_writer import bin_of, write_bam

    rnd = random.Random(6)
    reads = [read(f"r{k}", 0, rnd.randrange(60_000), "".join(rnd.choice("ACGTN") for _ in range(rnd.choice((1, 30, 70_000 if k == 5 else 99)))), contig=rnd.choice(("a", "b")), tags={"NS": k % 7}) for k in range(500)]
    rows, contigs = read_bam(spark, bam(tmp_path / "in.bam", [("a", 200_000), ("none", 10), ("b", 200_000)], reads))
    columns = ("qname", "flag", "tid", "contig", "pos", "mapq", "cigar", "mtid", "mpos", "tlen", "seq", "qual", "tags")
    assert write_bam(rows.repartition(5), contigs, str(tmp_path / "out.bam")) == 500
    whole, names = read_bam(spark, str(tmp_path / "out.bam"), 5_000)
    assert names.collect() == contigs.collect()
    got = whole.orderBy("ord").select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.select(*columns).collect()))
    assert [(r.tid, r.pos) for r in got] == sorted((r.tid, r.pos) for r in got)
    for region in (("a", 0, 500), ("b", 30_000, 45_000), ("b", 59_000, 70_000)):
        found = {r.qname for r in read_bam(spark, str(tmp_path / "out.bam"), 5_000, region)[0].collect()}
        assert {r.qname for r in got if r.contig == region[0] and r.pos < region[2] and r.pos + len(r.seq) > region[1]} <= found and len(found) < 300
    assert [bin_of(*x) for x in ((0, 1), (0, 1 << 14), (0, (1 << 14) + 1), (1 << 26, (1 << 26) + 5), (0, 1 << 29))] == [4681, 4681, 585, 4681 + 4096, 0]
    for name in ("t.bam", "t.sam"):
        tagged = tag_reads(spark, str(tmp_path / "out.bam"), str(tmp_path / name), "C", "T")
        back = open_reads(spark, str(tmp_path / name))[0]
        tags = lambda df: sorted((r.qname, r.tags["Yc"].i, r.tags["Zc"].i, r.tags["XB"].s) for r in df.collect())
        assert tags(back) == tags(tagged)


def test_intervals_from_standard_input(spark, monkeypatch):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("# x\nc0 5 9\nc1 7\n"))
    assert [tuple(r) for r in read_intervals(spark, "-").collect()] == [("c0", 5, 9), ("c1", 6, 7)]


def test_array_tags_are_there_without_a_value(spark, files):
    for expression, depth in (("exists('XB')", 1), ("tag('XB') == nil", 1), ("tag('XB') and 1 or 0", 1), ("not exists('XB')", 0)):
        got = count_sites(spark, files["bam"], files["fa"], Config(read_filter=expression)).where("pos = 6").collect()
        assert sum(r.a0 + r.a1 for r in got) == depth, expression


def test_router_slots_and_motifs(spark, files):
    sites = count_sites(spark, files["t_bam"], files["t_fa"], Config(read_filter=ROUTER, site_filter="ref == 'A' and (a + g) > 0", motif_pad=2))
    got = {(r.pos + 1, "-" if r.s else "+"): (r.a0, r.a1, r.g0, r.g1) for r in sites.collect()}
    assert got == {(5, "+"): (1, 1, 0, 1), (5, "-"): (2, 0, 0, 0), (6, "+"): (1, 2, 0, 0), (6, "-"): (2, 0, 0, 0), (7, "+"): (1, 2, 0, 0), (7, "-"): (1, 1, 0, 0), (8, "-"): (1, 1, 0, 0)}
    lines = [r.line for r in emit.lines(emit.by_template(count_sites(spark, files["t_bam"], files["t_fa"], Config(motif_pad=2, site_filter="ref == 'A'")), "{pos}{strand} {motif}")).collect()]
    assert lines == ["4+ GGAAA", "4- TTTCC", "5+ GAAAA", "5- TTTTC", "6+ AAAAC", "6- GTTTT", "7+ AAACC", "7- GGTTT"]
    high = count_sites(spark, files["t_bam"], files["t_fa"], Config(read_filter="bq >= 30"))
    assert {r.pos + 1: r.a0 for r in high.where("s = 0 AND pos IN (4, 5)").collect()} == {5: 2, 6: 3}


def test_indels_reverse_reads_and_filters(spark, files):
    events = {r.pos: (r.ins, r["del"], r.ref_skip, r.fail) for r in emit.composition(count_sites(spark, files["i_sam"], files["i_fa"]), events=True).collect()}
    assert (events[36], events[37], events[38]) == ((0, 1, 1, 0), (0, 1, 1, 0), (0, 0, 1, 0))
    first = emit.strandless(count_sites(spark, files["r_sam"], files["i_fa"])).where("pos = 1").first()
    assert (first.a, first.t) == (3, 0)
    one = lambda **k: count_sites(spark, files["r_sam"], files["i_fa"], Config(**k))
    assert {r.s for r in one(read_filter="flags & 16 == 0").collect()} == {0}
    assert {r.ref for r in one(site_filter="ref == 'A'").collect()} == {"A"}
    assert {r.pos + 1 for r in one(site_filter="ref == 'C' and g >= 0", region=parse_region("chr1:1-8")).collect()} == {2, 6}
    assert one(site_filter="depth >= 1000").count() == 0
    assert one(read_filter="!" * 64 + "(mapq >= 0)").count() == one().count()
    assert emit.vcf(one()).collect()[0].line == "chr1\t2\t.\tC\tT\t.\tPASS\t.\tGT:AD\t0/1:2,1"


def test_command_line_and_errors(spark, files):
    out = str(files["dir"] / "out.tsv")
    assert main(["-i", files["r_sam"], "-r", files["i_fa"], "-o", out, "--region", "chr1:1-2"], spark) == 0
    assert open(out).read().splitlines() == ["chrom\tpos\tstrand\tref\tdepth\ta\tc\tg\tt\tn", "chr1\t1\t+\tA\t1\t1\t0\t0\t0\t0", "chr1\t1\t-\tA\t2\t2\t0\t0\t0\t0", "chr1\t2\t+\tC\t1\t0\t1\t0\t0\t0", "chr1\t2\t-\tC\t2\t0\t1\t0\t1\t0"]
    assert main(["-i", files["r_sam"], "-r", files["i_fa"], "-e", "(( not lua !!", "-o", out], spark) == 2
    assert main(["-i", files["r_sam"], "-r", files["i_fa"], "--output-format", "{pos", "-o", out], spark) == 2
    assert main(["-i", "/nowhere.sam", "-r", files["i_fa"], "-o", out], spark) == 3
    for bad in ("chr1", "chrZ:1-2"):
        assert main(["-i", files["r_sam"], "-r", files["i_fa"], "--region", bad, "-o", out], spark) == 4
    assert main(["-i", files["r_sam"], "-r", files["i_fa"], "--ff", "nosuch", "-o", out], spark) == 1
    assert main(["-i", files["r_sam"], "-r", files["i_fa"], "--output-format", "{chrom}:{pos}\\t{a / 2}", "--fmt-header", "where\\thalf", "--strandless", "--region", "chr1:1-1", "-o", out], spark) == 0
    assert open(out).read() == "where\thalf\nchr1:0\t1.5\n"
    with pytest.raises(ExpressionError):
        count_sites(spark, files["r_sam"], files["i_fa"], Config(site_filter="depth >"))
    cram = files["dir"] / "x.cram"
    cram.write_bytes(b"CRAM....")
    with pytest.raises(InputError):
        open_reads(spark, str(cram))
    with pytest.raises(RegionError):
        parse_region("nocolon")


def test_intervals_index_summary_and_parts(spark, files):
    d = files["dir"]
    (d / "x.bed").write_text("# note\nchr1\t0 2\nchr1 9\nchr1\t7\t3\nchr1\n")
    assert sorted(tuple(r) for r in read_intervals(spark, str(d / "x.bed")).collect()) == [("chr1", 0, 2), ("chr1", 6, 7), ("chr1", 8, 9)]
    (d / "i.fa.fai").write_text("chr1\t60\t6\t60\t61\n")
    contigs = spark.createDataFrame([(0, "chr1"), (1, "chr9")], "tid int, contig string")
    there, gone = missing_contigs(contigs, read_index(spark, files["i_fa"]))
    assert (there.first().contig, gone.first().contig) == ("chr1", "chr9")
    with pytest.raises(FileNotFoundError, match="samtools faidx"):
        read_index(spark, files["fa"])
    done = run(spark, files["r_sam"], files["i_fa"], str(d / "o.tsv"), include=str(d / "x.bed"))
    assert done["rows"] == 8  # positions 1, 2, 7 and 9 on two strands
    table, head = formatted(count_sites(spark, files["r_sam"], files["i_fa"]), Output(alleles=True))
    assert head == ["chrom\tpos\tref\tdepth\tref_count\talt\talt_count"]
    write_parts(table, str(d / "parts"))
    assert spark.read.text(str(d / "parts")).count() == table.count() == 10
    assert [format_duration(x) for x in (0.5, 90, 3661)] == ["0.50s", "1m 30s", "1h 1m 1s"]


def test_streamed_counts_match_the_batch(spark, files):
    from sitecount.streaming.directory import running_counts, stream_reads

    reads, _ = open_reads(spark, files["r_sam"])
    reads.write.mode("overwrite").parquet(str(files["dir"] / "arrivals"))
    q = running_counts(stream_reads(spark, str(files["dir"] / "arrivals"))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.pos, r.s): (r.a, r.c, r.g, r.t) for r in spark.table("counts").collect()}
    want = {(r.pos, r.s): (r.a0, r.c0, r.g0, r.t0) for r in count_sites(spark, files["r_sam"], files["i_fa"], Config(dedup=False)).collect()}
    assert got == want


def test_arrivals_match_mates_within_a_file(spark, files, tmp_path):
    from sitecount.streaming.directory import count_arrivals, stream_sam, totals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text(open(files["sam"]).read())
    contigs = open_reads(spark, files["sam"])[1]
    out, how = str(tmp_path / "out"), {"checkpoint": str(tmp_path / "state"), "availableNow": True}
    count_arrivals(stream_sam(spark, str(tmp_path / "in"), contigs), out, **how).awaitTermination()
    want = {(r.pos, r.s): tuple(r[4:]) for r in site_table(open_reads(spark, files["sam"])[0], read_reference(spark, files["fa"]), Config()).drop("ref", "motif").collect()}
    got = {(r.pos, r.s): tuple(r[4:]) for r in totals(spark, out).collect()}
    assert {k: v for k, v in got.items() if k[0] < 80} == want
    (tmp_path / "in" / "b.sam").write_text(open(files["sam"]).read())
    count_arrivals(stream_sam(spark, str(tmp_path / "in"), contigs), out, **how).awaitTermination()
    assert {(r.pos, r.s): tuple(r[4:]) for r in totals(spark, out).collect()} == {k: tuple(2 * x for x in v) for k, v in got.items()}


def test_plan_of_a_file_in_parts(spark, files):
    """Reads of a name meet in one window over reads; all aggregates are hash aggregates, and none before the last two is keyed by name outside of overlaps."""
    sites = count_sites(spark, files["bam"], files["fa"])
    plan = sites._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("HashAggregate") >= 4
    assert plan.count("Window") >= 1 and "hashpartitioning(tid" in plan and "CASE WHEN" in plan


def test_metamorphic(spark, files):
    whole = count_sites(spark, files["t_bam"], files["t_fa"], Config(read_filter="mapq % 4"))
    total = lambda df: df.agg(F.sum(sum((F.col(f"{b}{k}") for b in "acgtn" for k in range(4)), F.lit(0)))).first()[0]
    parts = sum(total(count_sites(spark, files["t_bam"], files["t_fa"], Config(read_filter="mapq % 4", region=parse_region(r)))) for r in ("chrT:1-5", "chrT:6-12"))
    assert total(whole) == parts == total(emit.collapsed(whole))


def test_tiers_tags_and_letters_from_files(spark, files):
    from sitecount.api import run_tiers, tag_reads
    from sitecount.operators.tags import tag_stats
    from sitecount.plans.bases import padded_slice, reverse_complement

    out = str(files["dir"] / "tiers.tsv")
    assert run_tiers(spark, files["t_bam"], files["t_fa"], out)["rows"] == 3
    lines = open(out).read().splitlines()
    assert lines[0] == "chrom\tpos\tstrand\tmotif\tu0\tu1\tu2\tm0\tm1\tm2\tmutation_rate"
    # two good reads on plus, p_hi and p_g (G at 5); on minus, m_hi's bases are neither letter
    assert [x.split("\t")[:3] + x.split("\t")[5:9] for x in lines[1:3]] == [["chrT", "5", "+", "1", "0", "0", "1"], ["chrT", "6", "+", "2", "0", "0", "0"]]
    got = tag_reads(spark, files["t_bam"], str(files["dir"] / "tagged"), "C", "T", files["t_fa"])
    assert tag_stats(got).first().total_reads == 7 and spark.read.text(str(files["dir"] / "tagged")).where("value LIKE '%Yc:i:%'").count() == 7
    one = spark.createDataFrame([("ATGCGATCG",)], "seq string")
    c = lambda a, b: padded_slice(F.col("seq"), F.lit(a), F.lit(b))
    assert tuple(one.select(reverse_complement(F.lit("ATGC")), c(-2, 3), c(7, 12), c(-5, -2), c(20, 22), c(2, 4)).first()) == ("GCAT", "NNATG", "CGNNN", "NNN", "NN", "GC")
