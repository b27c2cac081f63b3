import random
import re
from collections import Counter

from sitecount.llm import quality_rules as qr


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a\nb\na\n\na b", "x " * 300, "é# 😀 <b> a\x0bb"] + ["".join(rnd.choice(["a ", "b ", "c\n", "d\t", "|", "\r", " "]) for _ in range(rnd.randrange(0, 90))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in qr.score(docs).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert tuple(got[i][c] for c in qr.COUNTS) == want, (i, t)
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].kept and got[i].base_failed)


def test_verdicts_and_kept_columns(spark):
    clean = " ".join(f"the word{i} of note{i}" for i in range(30))
    rows = [(1, clean, "p"), (2, " ".join(f"the{i}### of{i}$$$" for i in range(40)), "q"), (3, clean, "p"), (3, clean, "p"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    kept = qr.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]
    assert qr.keep(docs.limit(0)).count() == 0
    assert "symbols_per_word" in qr.score(docs).where("doc_id = 2").first().failed_rules


def test_very_long_texts_and_repeated_rows(spark):
    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randrange(200)}" + ("\n" if k % 40 == 39 else "") for k in range(30_000))
    one = "x" * 200_000
    docs = spark.createDataFrame([(1, long, "mine"), (1, long, "mine"), (2, one, None), (None, long, "mine")], "doc_id long, text string, n_lines string")
    got = [tuple(r[c] for c in qr.COUNTS) for r in qr.score(docs).orderBy(qr.F.col("doc_id").asc_nulls_last()).collect()]
    assert got == [brute(long), brute(long), brute(one), brute(long)]
    assert qr.keep(docs).columns == docs.columns
