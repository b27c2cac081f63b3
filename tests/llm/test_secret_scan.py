import hashlib
import random
import re

from sitecount.llm import secret_scan as ss

BASE = (
    ("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m.group(2)) >= 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 32, 0),
)


def base(text):
    found = [(m.start(), k, m.end(), m.group(g)) for k, (_, p, ok, g) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def held(rows):
    """The owners and the repositories of each value, and whether it is an example."""
    owners, repos = {}, {}
    for _, t, source, lang in rows:
        for *_, v in base(t):
            owners.setdefault(v, set()).add(source or "")
            repos.setdefault(v, set()).add((source or "", "/".join(x for x in (source, lang) if x is not None)))
    return owners, repos, {v: len(o) >= 3 or len(o) == 2 and len(repos[v]) >= 4 for v, o in owners.items()}


def brute(rows):
    owners, repos, example = held(rows)
    out = []
    for i, t, _, _ in rows:
        found = base(t)
        live = {(e - len(v), 3, e) for s, k, e, v in found if not example[v] and lively(v)}
        examples = {(e - len(v), e) for s, k, e, v in found if example[v]}
        names = lambda spans: ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        bare = [(s, k, e) for s, k, e, _ in found]
        out.append((str(i), *(sum(x[1] == k for x in bare) for k in range(3)), hashlib.sha256(names(bare).encode()).hexdigest(), names(sorted([*bare, *live])), len(live), len(examples), max((len(owners[v]) for *_, v in found), default=0), max((len(repos[v]) for *_, v in found), default=0)))
    return sorted(out)


def lively(v):
    return len(v) >= ss.LEAST_LENGTH and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= ss.LEAST_DIFFERENT and not any(p in v.lower() for p in ss.PLACEHOLDERS)


def corpus():
    rnd = random.Random(11)
    key = "AKIA" + "ABCDEFGH12345678"
    widely, own = "a1b2c3d4e5f60718293a4b5c6d7e8f90", "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    texts = [None, "", f"token = '{widely}'", f"Password:{widely} é😀", f"x {widely} y", f"api_key={own} {key}", f"apikey= {own}", "secret=short", "token=secret=abcdefgh12", "token=passwd=\"abcdefghij1234567\"", "AKIA123", "AKIA" * 9, "0" * 100_000, "token = your_example_key_1234567890"]
    for _ in range(150):
        texts.append("".join(rnd.choice(["token", "PASSWD", "api_key", "=", ":", " ", '"', "'", "abc", "0a1b2c3d", "AKIA", "XYZ9", "é", "😀", "_", "deadbeefdeadbeef"]) for _ in range(rnd.randrange(0, 25))))
    rows = [(None if i % 13 == 5 else i, t, None if i % 7 == 0 else f"s{i % 5}", rnd.choice(["en", None])) for i, t in enumerate(texts)]
    return rows + rows[2:4]


def test_spans_digests_and_ownership_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, found string")
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_live, r.n_example, r.n_owners, r.n_repos) for r in ss.scan(docs, *ss.places(docs)).collect())
    assert got == brute(rows)
    kept = ss.without_live(docs, *ss.places(docs))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(r[0]), r[1] or "") for r, b in zip(rows, [next(x for x in [brute_row(rows, r)]) for r in rows], strict=True) if not b)


def brute_row(rows, row):
    example = held(rows)[2]
    return any(not example[v] and lively(v) for *_, v in base(row[1]))


def test_repositories_tell_examples_of_two_owners(spark):
    """The same value at two owners: live in three repositories, an example in four; at one owner, live in any number of them."""
    value = "a1b2c3d4e5f60718293a4b5c6d7e8f90"
    places = {"three": [("o1", "x"), ("o1", "y"), ("o2", "x")], "four": [("o1", "x"), ("o1", "y"), ("o2", "x"), ("o2", "y")], "one": [("o1", c) for c in "abcdef"]}
    for name, found in places.items():
        docs = spark.createDataFrame([(k, f"token = {value}", o, r) for k, (o, r) in enumerate(found)], "doc_id long, text string, source string, lang string")
        got = ss.scan(docs, *ss.places(docs)).collect()
        assert {(r.n_live, r.n_example, r.n_owners, r.n_repos) for r in got} == {(int(name != "four"), int(name == "four"), len({o for o, _ in found}), len(found))}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert ss.scan(docs, *ss.places(docs)).count() == 0 and ss.without_live(docs, *ss.places(docs)).count() == 0
