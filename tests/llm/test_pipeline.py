"""The pipeline on a small corpus, against each stage done by hand."""

import random

import corpus_pipeline
import pytest
from sitecount.llm import mixing as mx
from test_minhash_dedup import groups
from test_mixing import brute as mixed_by_hand
from test_quality_rules import brute as counts_by_hand


def text(rnd, n, lead="the"):
    return " ".join(f"{lead} w{rnd.randrange(900)}" if k % 5 == 0 else f"w{rnd.randrange(900)}" for k in range(n))


def corpus():
    rnd = random.Random(8)
    items = [text(rnd, 30) for _ in range(6)]
    docs = []
    for k in range(40):
        docs.append([k, text(rnd, rnd.randrange(60, 120)), "en" if k % 3 else "de", f"src{k % 6}"])
    docs += [[100 + k, docs[k][1] + " end", "en", "src1"] for k in range(6)]  # near copies
    docs += [[200 + k, docs[k][1], "fr", "src2"] for k in range(4)]  # exact copies
    docs += [[300 + k, "few words", "en", "src0"] for k in range(3)]
    docs += [[400 + k, " ".join(f"w{rnd.randrange(99)}###" for _ in range(70)), "en", "src0"] for k in range(3)]
    docs += [[500 + k, f"{text(rnd, 50)} {items[k]} {text(rnd, 20)}", "en", "src3"] for k in range(3)]
    docs += [[600 + k, f"{text(rnd, 60)} token = \"{rnd.randrange(16**40):040x}\" end", "en", "src4"] for k in range(2)]
    docs += [[700 + k, f"{text(rnd, 60)} token = \"a1b2c3d4e5f60718293a4b5c6d7e8f9012345678\" end", "en", f"src{k}"] for k in range(4)]
    docs += [[800, None, None, None], [801, "", "en", "src1"]]
    return docs, items


@pytest.mark.parametrize("empty", [False, True])
def test_rows_match_stages_done_by_hand(spark, tmp_path, empty):
    docs, items = corpus()
    rows = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in docs if not empty]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r.doc_id), r.domain, r.lang, r.source, r.n_tokens, r.n_epochs) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    good = [d for d in docs if (c := counts_by_hand(d[1]))[0] >= 50 and 2 * c[4] <= c[0] and 4 * c[2] <= c[0] and not empty]
    least = {i for i, _, top in groups([(d[0], d[1]) for d in good], 5) if i == top}
    left = [d for d in good if d[0] in least and not 500 <= d[0] < 700]
    assert empty or {d[0] for d in left} >= {*range(40), *range(700, 704)} and len(left) == 44
    named = [(i, t, f"d{int(src[3:]) % 3}", lang, src) for i, t, lang, src in left]
    assert got == mixed_by_hand(named, mx.SHARE, mx.EPOCHS, mx.SEED, mx.WEIGHTS)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "decontamination", "secret_scan", "mixing"]
    docs, items = corpus()
    rows = [(i, t, lang, src, None if t is None else len(t), k) for k, (i, t, lang, src) in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, table, str(tmp_path))
        assert left.schema == table.schema and 0 < left.count() < len(rows)
        assert left.exceptAll(table).isEmpty()
