import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F
from sitecount.llm import mixing as mx


def fill(budget, children):
    """Shares of a budget by weight, capped, by capping one child after another."""
    share, left, open_ = {}, budget, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        level = Fraction(left, total) if total else Fraction(0)
        low = min(open_, key=lambda k: (Fraction(open_[k][1], open_[k][0]), k))
        w, cap = open_[low]
        if level >= Fraction(cap, w):
            share[low], left = cap, left - cap
            del open_[low]
            continue
        for k, (w, cap) in open_.items():
            share[k] = max(0, min(cap, int(level * w)))
        break
    return share


def brute(rows, share, epochs, seed, weights):
    leaves = {}
    for i, text, *names in rows:
        leaf = tuple(n if n is not None else mx.NONE for n in names)
        leaves.setdefault(leaf, []).append((i, len((text or "").split())))
    avail = {k: sum(n for _, n in v) for k, v in leaves.items()}
    w = lambda level, name: round(weights.get(level, {}).get(name, 1) * mx.PARTS)
    live = {k for k in leaves if all(w(level, k[j]) for j, level in enumerate(mx.LEVELS))}
    budgets = {(): int(sum(avail.values()) * share)}
    for depth, level in enumerate(mx.LEVELS):
        new = {}
        for node, b in budgets.items():
            names = {k[depth] for k in leaves if k[:depth] == node}
            children = {n: (w(level, n), sum(avail[k] * epochs for k in live if k[: depth + 1] == (*node, n))) for n in names if w(level, n)}
            new |= {(*node, n): s for n, s in fill(b, children).items()}
        budgets = new
    out = []
    for leaf, docs in leaves.items():
        b, a = budgets.get(leaf, 0), avail[leaf]
        whole = b // a if a else 0
        rest, upto = b - whole * a, 0
        order = sorted(docs, key=lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest())
        groups = {}
        for i, n in order:
            groups.setdefault(hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), []).append((i, n))
        for _, same in sorted(groups.items()):
            upto += sum(n for _, n in same)
            for i, n in same:
                times = whole + (upto <= rest)
                if times:
                    out.append((str(i), *leaf, n, times))
    return sorted(out)


def test_budgets_and_prefixes_match_brute_force(spark):
    rnd = random.Random(2)
    rows = [(None if k % 29 == 3 else k, None if k % 17 == 0 else " ".join("w" for _ in range(rnd.choice((0, 1, 5, 50)))), rnd.choice(["d0", "d0", "d1", None]), rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["s1", "s2", "s3", "s3", None])) for k in range(400)]
    rows += rows[5:9]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, dom string, lang string, source string, n_tokens int")
    for share, epochs, seed, weights in ((0.6, 2, 17, mx.WEIGHTS), (0.2, 1, 3, {}), (1.7, 2, 5, {"domain": {"d1": 5}, "lang": {"de": 0}}), (5.0, 3, 1, {})):
        got = mx.mix(docs, F.col("dom"), share, epochs, seed, weights)
        assert sorted((str(r.doc_id), r.domain, r.lang, r.source, r.n_tokens, r.n_epochs) for r in got.collect()) == brute(rows, share, epochs, seed, weights)


def test_many_ranges_take_the_same_documents(spark, monkeypatch):
    rows = [(k, " ".join("w" for _ in range(k % 7)), "d0", "en", "s1") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string")
    monkeypatch.setattr(mx, "RANGE", 16)
    monkeypatch.setattr(mx, "BROADCAST_ROWS", 0)
    got = sorted((str(r.doc_id), r.domain, r.lang, r.source, r.n_tokens, r.n_epochs) for r in mx.mix(docs, F.col("dom"), 0.37, 1, 9, {}).collect())
    assert got == brute(rows, 0.37, 1, 9, {})
    assert mx.mix(docs.limit(0), F.col("dom")).count() == 0


def test_very_long_and_repeated_documents(spark):
    long = "w " * 250_000
    rows = [(1, long, "d0", "en", "s1"), (1, long, "d0", "en", "s1"), (2, "", "d0", "en", "s1"), (None, "a b", None, None, None), (3, None, "d1", "de", "s1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, dom string, lang string, source string, budget string")
    for share in (0.4, 1.0, 3.0):
        got = sorted((str(r.doc_id), r.domain, r.lang, r.source, r.n_tokens, r.n_epochs) for r in mx.mix(docs, F.col("dom"), share, 2, 1, {}).collect())
        assert got == brute(rows, share, 2, 1, {})
