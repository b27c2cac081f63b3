import random

import numpy as np
from sitecount.llm import decontamination as dc
from sitecount.llm.common import WordHash


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rnd, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        k, what = rnd.randrange(len(out)), rnd.randrange(3)
        if what == 0:
            out[k] = rnd.choice(vocabulary)
        elif what == 1:
            out.insert(k, rnd.choice(vocabulary))
        elif len(out) > 1:
            del out[k]
    return out


def test_distances_match_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        a = np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, 8))], dtype=np.uint64)
        b = np.array([rnd.randrange(4) for _ in range(rnd.randrange(0, 12))], dtype=np.uint64)
        got = dc.distances(a, b)
        for end in range(len(b) + 1):
            assert got[end] == min(edit(a.tolist(), b[s:end].tolist()) for s in range(end + 1))
        assert dc.anchored(a, b).tolist() == [edit(a.tolist(), b[:end].tolist()) for end in range(len(b) + 1)]


def test_recall_of_planted_passages_and_no_hits_elsewhere():
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 70))] for _ in range(150)]
    hashes = WordHash()
    h = lambda ws: hashes.of([w.encode() for w in ws])
    index = dc.Index([(i, h(ws)) for i, ws in enumerate(items)])
    found = {0.0: [], 0.1: [], 0.2: []}
    for i, ws in enumerate(items):
        for part in found:
            copy = changed(rnd, ws, min(dc.allowed(len(ws)), int(part * len(ws))), vocabulary)
            text = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 90))] + copy + [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 90))]
            hits = index.find(h(text))
            found[part].append(i in [x[0] for x in hits])
            for ident, a, b, d in hits:
                assert edit(items[ident], text[a:b]) == d <= dc.allowed(len(items[ident]))
    assert all(found[0.0]) and np.mean(found[0.1]) > 0.97 and np.mean(found[0.2]) > 0.9, {k: np.mean(v) for k, v in found.items()}
    clean = [index.find(h([rnd.choice(vocabulary) for _ in range(400)])) for _ in range(100)]
    assert not any(clean)


def test_rows_kept_and_odd_inputs(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x y " + item.upper() + " z", "p"), (2, None, "q"), (3, "", None), (4, "x y z " * 400, "r"), (None, item, "s"), (1, "x y " + item.upper() + " z", "p")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, None), (None, item), (12, "a b"), (13, item)], "item_id long, text string")
    got = sorted(tuple(map(str, r)) for r in dc.leaks(docs, bench).collect())
    assert got == sorted((str(i), str(k), "1", "0", span) for i, span in ((1, "2:22"), (1, "2:22"), (None, "0:20")) for k in (10, 13))
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert dc.leaks(docs.limit(0), bench).count() == 0 and dc.leaks(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == 6


def planted(sizes):
    """Items, and texts that hold one of each with as many edits as it allows: mixed ones, insertions, deletions."""
    rnd = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    hashes = WordHash()
    h = lambda ws: hashes.of([w.encode() for w in ws])
    pick = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items, texts = [pick(n) for n in sizes], []
    for i, ws in enumerate(items):
        edits = dc.allowed(len(ws))
        gone = set(rnd.sample(range(len(ws)), edits))
        wider = list(ws)
        for _ in range(edits):
            wider.insert(rnd.randrange(len(wider) + 1), rnd.choice(vocabulary))
        for copy in (changed(rnd, ws, edits, vocabulary), wider, [w for k, w in enumerate(ws) if k not in gone]):
            texts.append((i, h(pick(90) + copy + pick(90))))
    return [(i, h(ws)) for i, ws in enumerate(items)], texts


def test_no_long_passage_within_the_bound_is_missed():
    items, texts = planted([59, 100, 200, 400] * 4)
    index = dc.Index(items)
    assert [[x[0] for x in index.find(t)] for _, t in texts] == [[i] for i, _ in texts]


def test_texts_counted_in_parts_have_the_same_hits(monkeypatch):
    items, texts = planted([6, 15, 40, 100])
    text = np.concatenate([t for _, t in texts])
    whole = dc.Index(items).find(text)
    monkeypatch.setattr(dc, "AT_ONCE", 20)
    assert dc.Index(items).find(text) == whole and {x[0] for x in whole} == {0, 1, 2, 3}


def test_adjacent_copies_are_hits_of_their_own():
    rnd = random.Random(3)
    hashes = WordHash()
    h = lambda ws: hashes.of([w.encode() for w in ws])
    item = [f"w{k}" for k in range(30)]
    index = dc.Index([(7, h(item))])
    assert index.find(h(item * 2)) == [(7, 0, 30, 0), (7, 30, 60, 0)]
    assert index.find(h(item * 50)) == [(7, k, k + 30, 0) for k in range(0, 1500, 30)]
    edited = [*item[:10], "x", *item[11:20], "y", *item[21:]]
    assert index.find(h(item + edited + item)) == [(7, 0, 30, 0), (7, 30, 60, 2), (7, 60, 90, 0)]
    text = [w for _ in range(20) for w in (*changed(rnd, item, 3, ["a", "b", "c"]), *["z"] * rnd.randrange(3))]
    found = index.find(h(text))
    assert len(found) == 20 and all(a[2] <= b[1] for a, b in zip(found, found[1:]))
    for _, a, b, d in found:
        assert edit(item, text[a:b]) == d <= dc.allowed(30)


def test_short_items_and_ones_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e a b"), (2, "p q r s"), (3, "q r s t u"), (4, "A"), (5, "one two three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "a b"), (11, "a"), (12, "q r s"), (13, "p q r s"), (None, "one two three four five six"), (14, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.spans) for r in dc.leaks(docs, bench).collect())
    assert got == [(1, 10, "0:2,5:7"), (1, 11, "0:1,5:6"), (2, 12, "1:4"), (2, 13, "0:4"), (3, 12, "0:3"), (4, 11, "0:1")]
    assert dc.clean(docs, bench).count() == 0
    assert [r.doc_id for r in dc.clean(docs, bench.where("item_id IS NULL")).collect() if r.doc_id == 5] == []


def test_query_rows_match_an_exhaustive_search(spark):
    """Each document against each item, at every window: the pairs within the bound, and the least distance."""
    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.choice((1, 2, 3, 5, 7, 12, 25)))] for _ in range(14)]
    texts = []
    for k in range(60):
        parts = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 3)):
            ws = rnd.choice(items)
            parts += changed(rnd, ws, rnd.randrange(0, 1 + dc.allowed(len(ws)) + (k % 4 == 0)), vocabulary) + [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 12))]
        texts.append(parts)
    want = {}
    for d, t in enumerate(texts):
        for i, ws in enumerate(items):
            least = min(edit(ws, t[a:b]) for a in range(len(t) + 1) for b in range(a, min(len(t), a + len(ws) + dc.allowed(len(ws))) + 1))
            if least <= dc.allowed(len(ws)):
                want[d, i] = least
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.distance for r in dc.leaks(docs, bench).collect()} == want
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == set(range(60)) - {d for d, _ in want}


def test_several_blocks_and_a_very_long_text(spark, monkeypatch):
    rnd = random.Random(4)
    items = [[f"i{k}w{j}" for j in range(20)] for k in range(9)]
    long = [f"x{rnd.randrange(500)}" for _ in range(40_000)] + items[3] + ["y"] * 30_000
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(items[8][:19])), (3, "nothing"), (4, " ".join(items[0] + items[5]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id long, text string").coalesce(1)
    one = sorted(map(tuple, dc.leaks(docs, bench).collect()))
    assert [x[:4] for x in one] == [(1, 3, 1, 0), (2, 8, 1, 1), (4, 0, 1, 0), (4, 5, 1, 0)] and one[0][4] == "40000:40020"
    whole = dc.blocks
    monkeypatch.setattr(dc, "blocks", lambda b, **how: whole(b, limit=45, **how))
    assert sorted(map(tuple, dc.leaks(docs, bench).collect())) == one and [r.doc_id for r in dc.clean(docs, bench).collect()] == [3]
