import hashlib
import random

from sitecount.llm import substring_dedup as sd


def brute(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for ws in words:
        for i in range(len(ws) - size + 1):
            k = tuple(ws[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for ws in words:
        gone = {i + j for i in range(len(ws) - size + 1) if seen[tuple(ws[i : i + size])] > 1 for j in range(size)}
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rnd, n, letters):
    texts = [None, "", " \t", "x"]
    pool = [" ".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 30))) for _ in range(8)]
    for _ in range(n):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else " ".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 25))) for _ in range(rnd.randrange(1, 7))]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(parts))
    return texts + texts[4:8] + [texts[6]]


def test_matches_brute_force_at_several_sizes(spark):
    rnd = random.Random(5)
    for size, letters in ((1, "ab"), (2, "abc"), (5, "ab"), (9, "abcdefé"), (16, "ab"), (35, "ab"), (50, "abcd")):
        texts = corpus(rnd, 30, letters)
        if size >= 35:
            texts += [" ".join("ab"[i % 2] for i in range(300)), " ".join(["ab"] * 200)]
        rows = [(None if i % 11 == 3 else i // 2, t, "z") for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in sd.deduplicate(docs, size).collect())
        assert got == sorted((str(r[0]), *b) for r, b in zip(rows, brute(texts, size), strict=True)), size


def test_levels_double_and_pass_on_what_is_repeated(spark):
    assert [sd.levels(s) for s in (1, 12, 13, 35, 50)] == [(1,), (12,), (7, 13), (9, 18, 35), (7, 13, 25, 50)]
    rnd = random.Random(2)
    shared = [f"s{k}" for k in range(60)]
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = [words(80) + shared[:length] + words(80) for length in (12, 12, 25, 25, 60, 60)]
    hashes, powers = sd.WordHash(), sd.Powers()
    place, *keys, _ = zip(*(sd.runs(hashes.of([w.encode() for w in t]), 35, powers) for t in texts), strict=True)
    often = [[sum(int(sum((x == h).sum() for x in key) > 1) for h in own) for own in key] for key in keys]
    # 12 words can't repeat at the level of 18
    assert sum(often[0][:4]) > sum(often[1][:4]) and often[1][:2] == [0, 0] and min(often[0][4:] + often[1][4:]) > 0
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.n_removed for r in sd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 60, 5: 60}


def test_long_and_odd_rows(spark):
    """A very long text, repeated rows, nulls, and columns named like the operator's own."""
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(50)}" for _ in range(60_000))
    rows = [(1, long, 5), (2, None, 5), (None, " ".join(f"u{k}" for k in range(50)), 5), (3, "few words", None), (3, "few words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seed long")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in sd.deduplicate(docs).collect())
    assert got == [("1", 60_000, brute([long], 35)[0][1]), ("2", 0, 0), ("3", 2, 0), ("3", 2, 0), ("None", 50, 0)]


def test_empty_table_and_kept_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x b c d y")], "doc_id long, text string")
    assert sd.deduplicate(docs.limit(0)).count() == 0
    assert {r.doc_id: r.kept for r in sd.deduplicate(docs, 3, texts=True).collect()} == {1: "a e f", 2: "x y"}
