import itertools
import os
import random

import numpy as np
import pytest
from sitecount.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_patterns_code_and_decode():
    for v in itertools.product((-1, 0, 1), repeat=qc.LABELLERS):
        assert tuple(qc.decode(qc.code(v))) == v


def test_em_finds_accuracies_of_simulated_labellers():
    rnd = np.random.default_rng(1)
    right = [0.95, 0.9, 0.85, 0.8, 0.7, 0.9, 0.6, 0.8]
    counts, truth = {}, []
    for _ in range(8000):
        y = int(rnd.random() < 0.7)
        v = [0 if rnd.random() < 0.3 else (1 if y else -1) * (1 if rnd.random() < a else -1) for a in right]
        v = [min(0, x) if j in qc.ONE_SIDED else x for j, x in enumerate(v)]
        counts[qc.code(v)] = counts.get(qc.code(v), 0) + 1
        truth.append((qc.code(v), y))
    posterior, table = qc.fit_labellers(counts)
    for j, a in enumerate(right):
        got = 1 - table[j, 1, 0] / 0.7 if j in qc.ONE_SIDED else table[j, 1, 2]
        assert abs(got - a) < 0.05
    assert np.mean([(posterior[p] > 0.5) == y for p, y in truth]) > 0.93


def test_odd_inputs(spark):
    rnd = random.Random(0)
    clean = [" ".join(rnd.choice("the of and a word other text here some more".split()) + (".\n" if k % 9 == 8 else "") for k in range(60)) for _ in range(40)]
    junk = [" | ".join(f"w{rnd.randrange(99)}###" for _ in range(40)) for _ in range(10)]
    rows = [(i, t, "x") for i, t in enumerate(clean + junk)] + [(90, None, None), (91, "", "y"), (None, clean[0], "z"), (0, clean[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    weights, bias, _ = qc.fit(docs)
    got = [(r.doc_id, r.kept) for r in qc.score(docs, weights, bias).collect()]
    assert len(got) == len(rows)
    assert all(k for i, k in got if i is None or i < 40) and not any(k for i, k in got if i is not None and i >= 40)
    none = docs.limit(0)
    assert qc.score(none, *qc.fit(none)[:2]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights, bias, _ = qc.fit(docs)
    got = qc.score(docs, weights, bias).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in got]) > 0.93
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98


def test_the_sample_is_bounded_whatever_the_ids(spark):
    """Rows without ids, of one id, and one row very many times: never more rows than asked for, and each row at most once."""
    many = [(None, f"text {k} of its own") for k in range(1500)] + [(7, f"other text {k}") for k in range(1500)] + [(None, "the same row")] * 1500 + [(9, None), (None, "long " * 50_000)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    got = [bytes(r.t) for r in qc.sampled(docs.where("text IS NOT NULL"), len(many), 100, "doc_id", "text").collect()]
    assert 40 < len(got) <= 100 and len(set(got)) == len(got)
    assert qc.sampled(docs, 1, 5000, "doc_id", "text").count() == 3003
    weights, bias, _ = qc.fit(docs, sample=100)
    assert qc.score(docs, weights, bias).count() == len(many)
