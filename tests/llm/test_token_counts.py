import random

from sitecount.llm import token_counts as tc


def greedy(pieces, symbols):
    n, at = 0, 0
    while at < len(symbols):
        for end in range(len(symbols), at, -1):
            if symbols[at:end] in pieces:
                n, at = n + 1, end
                break
        else:
            return 1
    return n


def test_automaton_counts_what_greedy_matching_builds():
    rnd = random.Random(3)
    for _ in range(300):
        pieces = {tuple(rnd.choice((97, 98, 99, tc.END)) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 25))}
        a = tc.Automaton(pieces)
        for _ in range(30):
            w = (*(rnd.choice((97, 98, 99)) for _ in range(rnd.randrange(0, 12))), tc.END)
            assert a.count(w) == greedy(pieces, w)


def test_real_vocabulary_and_rows(spark):
    pieces = tc.read_vocabulary()
    known = set(pieces)
    rows = [(1, "The  unaffable\tCATS été 漢字 " + "x" * 5000, 5), (2, None, 6), (3, " \n", 7), (3, "a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted(tuple(r) for r in tc.count_tokens(docs).collect())
    want = []
    for i, t, _ in rows:
        ws = (t or "").encode().lower().split()
        want.append((i, len(ws), sum(greedy(known, (*w, tc.END)) if len(w) < 100 else tc.Automaton(pieces).count((*w, tc.END)) for w in ws)))
    assert got == sorted(want)
    assert tc.count_tokens(docs.limit(0)).count() == 0
