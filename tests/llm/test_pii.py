import hashlib
import random
import re

import pytest
from sitecount.llm import pii

BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15),
}


def plain(text):
    return {k: [m.span() for m in p.finditer(text) if ok(m)] for k, (p, ok) in BASE.items()}


@pytest.mark.parametrize("alphabet", ["a1.@-+ ", "0123456789.", "45 -9", "+1 ().-2", "ab@.c-_%é"])
def test_base_detectors_match_the_plain_patterns(alphabet):
    rnd = random.Random(7)
    for _ in range(4000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 40)))
        assert pii.detect(t) == plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to jane [at] mail [dot] example [dot] com now", "email", "jane [at] mail [dot] example [dot] com"),
        ("write to jane at example dot com now", "email", "jane at example dot com"),
        ("é jаne@example.com", "email", "jаne@example.com"),
        ("call plus four four two zero seven nine four six zero nine five eight now", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("host １０.0.0.1 up", "ip", "１０.0.0.1"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_hidden_spans_map_back_to_the_source(text, kind, found):
    _, every = pii.scan(text)
    assert found in [text[a:b] for a, b in every[kind]]


@pytest.mark.parametrize("text", ["", None, "he was at home dot dot dot", "one two three", "one of the two at nine", "look at example.com today", "1.2.3.400", "+12 34"])
def test_clean_texts_have_no_spans(text):
    assert pii.render(pii.scan(text)[1]) == ""


def test_long_texts_are_linear():
    assert pii.scan("1" * 300_000)[1]["ip"] == []
    assert pii.scan("a" * 300_000 + "@")[1]["email"] == []


def test_query_rows(spark):
    rows = [(1, "a@b.co 10.0.0.1", "x"), (2, None, None), (2, "", "y"), (3, "j (at) k.org", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(tuple(r) for r in pii.find(docs).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 1, 1, 0, 0, hashlib.sha256(b"email:0:6,ip:7:15").hexdigest(), "email:0:6,ip:7:15", 0), (2, 0, 0, 0, 0, none, "", 0), (2, 0, 0, 0, 0, none, "", 0), (3, 0, 0, 0, 0, none, "email:0:12", 1)]
    assert pii.find(docs.limit(0)).count() == 0
    assert pii.mask("a@b.co x", pii.scan("a@b.co x")[1]) == "<email> x"


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail admin@corp[.]com today", "email", "admin@corp[.]com"),
        ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
        ("mail admin@corp (dot) com today", "email", "admin@corp (dot) com"),
        ("mail admin[@]corp.com today", "email", "admin[@]corp.com"),
        ("mail admin {at} corp.com today", "email", "admin {at} corp.com"),
        ("mail admin at corp dot com today", "email", "admin at corp dot com"),
        ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
        ("host one zero zero.0.0.1 up", "ip", "one zero zero.0.0.1"),
        ("mail аdmin@corp.com today", "email", "аdmin@corp.com"),
    ],
)
def test_each_rewrite_alone(text, kind, found):
    _, every = pii.scan(text)
    assert found in [text[a:b] for a, b in every[kind]]


@pytest.mark.parametrize("parts", [["a", "@", "b", ".", "[", "]", " ", "at", "com"], ["10", "1", ".", "(.)", " [.] ", "one ", "two "], ["plus ", "44", " 20 7946", "0958", "dot", " dot ", "ſix ", "é"], ["un ", "DEUX ", "fünf ", "zéro-", "İ", "uno ", "eıns ", "k punkt ", "arroba ", "a ", "más 4", " point de"]])
def test_no_text_is_left_out_before_the_rewrites(parts):
    rnd = random.Random(5)
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14)))
        tape = pii.signs(pii.spelled_digits(pii.homoglyphs(pii.Tape.of(t))))
        want = {k: got for k, found in pii.detect(tape.text).items() if (got := [(tape.start[a], tape.end[b - 1]) for a, b in found if any(tape.changed[a:b])])}
        assert pii.hidden(t) == want, t


def disguised(rnd, kind):
    """An identifier, written in one of the disguises."""
    words = rnd.choice(pii.DIGITS)
    spell = lambda digits: " ".join(words[int(c)] for c in digits)
    name = lambda: "".join(rnd.choice("abcdefghkmqrt") for _ in range(rnd.randrange(3, 8)))
    if kind == "email":
        (ats, dots), parts = rnd.choice(pii.AT_DOT), [name() for _ in range(rnd.randrange(2, 4))]
        at, dot = rnd.choice(ats), rnd.choice(dots)
        left, right = rnd.choice((("[", "]"), (" (", ") "), (" {", "} "), (" ", " "), (" < ", " >")))
        if rnd.random() < 0.2:
            return name() + "＠" + ".".join(parts)
        return name() + f"{left}{at}{right}" + f"{left}{dot}{right}".join(parts)
    if kind == "ip":
        dot = rnd.choice(("[.]", "(dot)", " [punto] ", " punkt ", "．"))
        return dot.join(str(rnd.randrange(256)) for _ in range(4))
    if kind == "card":
        digits = "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(12, 19)))
        return spell(digits + next(c for c in "0123456789" if pii.luhn(digits + c)))
    digits = "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(9, 16)))
    return rnd.choice((f"{rnd.choice(pii.PLUS_WORDS)} {digits}", f"{rnd.choice(pii.PLUS_WORDS)} {spell(digits)}", f"+{digits[0]} {spell(digits[1:])}"))


@pytest.mark.parametrize("kind", pii.KINDS)
def test_disguises_are_found_where_they_stand(kind):
    rnd = random.Random(12)
    for _ in range(1500):
        before, after = (rnd.choice(("", "wörter davor; ", "escribe a: ", "x, ", "le voici\n", "(")) for _ in range(2))
        found = disguised(rnd, kind)
        text = f"{before}{found};{after}"
        _, every = pii.scan(text)
        assert (len(before), len(before) + len(found)) in every[kind], text


@pytest.mark.parametrize("text", ["juan arroba correo punto es", "hans [at] firma [punkt] de", "jean arobase poste point fr", "joe@site[.]com"])
def test_signs_in_four_languages(text):
    assert pii.scan(text)[1]["email"] == [(0, len(text))]


@pytest.mark.parametrize(
    "text",
    ["look at the point that matters and the dot at the end", "un deux trois, nous irons au bois; six ou sept fois", "Punkt eins, zwei und drei des Plans; null Problem", "uno dos tres, al punto de partida; más de 5 veces", "plus 5 points, mas 20 puntos"],
)
def test_prose_in_four_languages_is_left_alone(text):
    assert pii.render(pii.scan(text)[1]) == ""


def test_many_spans_take_linear_time():
    import time

    text = "a@b.co c[at]d.org " * 20_000
    began = time.process_time()
    base, every = pii.scan(text)
    assert len(base["email"]) == 20_000 and len(every["email"]) == 40_000 and time.process_time() - began < 10
