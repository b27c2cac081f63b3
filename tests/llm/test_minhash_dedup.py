import random

import numpy as np
from sitecount.llm import minhash_dedup as md
from sitecount.llm.components import components


def shingle_set(t, size):
    ws = (t or "").encode().lower().split()
    if not ws:
        return frozenset()
    size = min(size, len(ws))
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))


def groups(rows, size):
    """(id, set size, least linked id) by comparing all pairs."""
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(rnd):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "one two", "ONE\ttwo", "é a"]
    for _ in range(14):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 6, 12, 40, 150, 600)))]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 10)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(rnd.choice((" ", "\n")).join(copy))
    return list(enumerate(texts))


def test_components_and_sizes_match_brute_force(spark):
    for size, seed in ((2, 1), (5, 2)):
        rows = corpus(random.Random(seed))
        docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n int")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in md.label(docs, size).collect())
        assert got == groups(rows, size)


def test_crowded_buckets(spark, monkeypatch):
    """Copies at different distances from a base, of which many are linked with nothing: links agree with brute force."""
    monkeypatch.setattr(md, "FEW", 3)
    rnd = random.Random(6)
    rows = []
    for base in ([f"w{rnd.randrange(300)}" for _ in range(60)] for _ in range(2)):
        for _ in range(45):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, 2, 4, 5, 6, 7))):
                copy[rnd.randrange(60)] = f"w{rnd.randrange(300)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in md.label(docs, 2).collect()) == groups(rows, 2)


def test_crowd_filter_loses_no_link(spark):
    """Of one crowd, links with the pivot and candidates hold every link across components, and few other pairs."""
    rnd = random.Random(9)
    for percent in (60, 80, 95):
        base = [rnd.getrandbits(63) for _ in range(120)]
        sets = []
        for k in range(160):
            s = set(base) if (k + 1) % 8 else set(rnd.sample(base, 50)) | {rnd.getrandbits(63) for _ in range(30)}
            for _ in range(rnd.choice((0, 3, 8, 10, 12, 14, 20, 30))):
                s.discard(rnd.choice(base))
                s.add(rnd.choice((rnd.getrandbits(63), rnd.randrange(40))))
            sets.append(sorted(s))
        table = spark.createDataFrame([(k, np.array(s, dtype=np.uint64).tobytes()) for k, s in enumerate(sets)], "node long, hashes binary")
        there = spark.createDataFrame([(key, k, k, 160, 0) for k in range(160) for key in (1, 2)], "key long, node long, c long, many long, least long")
        links, pairs = (sorted(map(tuple, x.collect())) for x in md.crowded(there, table, percent))
        true = [(x, y) for x in range(160) for y in range(x + 1, 160) if 100 * len(set(sets[x]) & set(sets[y])) >= percent * len(set(sets[x]) | set(sets[y]))]
        reach = {0} | {y for _, y in links}
        assert all((min(p), max(p)) in true for p in links)
        assert all((x, y) in pairs or x in reach and y in reach for x, y in true)
        assert len(set(pairs) - set(true)) < 0.2 * 160 * 159 / 2


def test_large_and_shared_ids(spark):
    """Ids of any size are ids, and rows of one id with different texts are looked at each."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    big = 5_000_000_000_000_000_000
    rows = [(big, one), (big + 1, one + " x"), (-7, two), (3, two + " y"), (9, one), (9, two), (None, "some text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in md.label(docs, 2).collect())
    assert got == sorted([(str(big), 59, "9", False), (str(big + 1), 60, "9", False), ("-7", 59, "-7", True), ("3", 60, "-7", False), ("9", 59, "9", True), ("9", 59, "-7", False), ("None", 1, "None", True)])


def test_kept_rows_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " x", "b"), (None, text, "c"), (None, "lonely words here", None), (5, None, "d"), (6, None, "d"), (7, "other text of its own", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = md.keep(docs, 5)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.node) for r in kept.collect()) == [("1", "a"), ("5", "d"), ("6", "d"), ("7", "e"), ("None", None)]
    assert md.keep(docs.limit(0), 5).count() == 0
    assert sorted((str(r.doc_id), str(r.component_id)) for r in md.label(docs, 2).collect()) == [("1", "1"), ("1", "1"), ("2", "1"), ("5", "5"), ("6", "6"), ("7", "7"), ("None", "1"), ("None", "None")]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    sketch = md.Sketch()
    for j in (0.2, 0.5, 0.8, 0.95):
        got = []
        for _ in range(40):
            union = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
            both = int(j * 2000)
            half = (2000 - both) // 2
            a, b = np.sort(union[: both + half]), np.sort(np.concatenate((union[:both], union[both + half :])))
            got.append(md.estimate(sketch.of(a)[None], sketch.of(b)[None])[0])
        assert abs(np.mean(got) - j) < 0.02


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (5, 3), (5, 3)]
    got = dict(components(spark.createDataFrame(links, "x long, y long")).distinct().collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
