"""Personal data: detection on the text as it stands, and on a normalised form whose spans map back to the source.

The base detectors find e-mail addresses, IPv4 addresses, payment cards and phone numbers in the source. The method then
runs transducers over a tape (characters, and for each the span of the source that it came from): homoglyphs become ASCII,
disguised ``at`` and ``dot`` become ``@`` and ``.``, spelled digits become digits, in English, German, French and Spanish. The detectors run on
the tape, and spans that went through at least one rewrite are mapped back to source characters and added; base spans always stay.

Null text counts as empty. Every detector is linear in the text, so very long texts need no limit.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import each

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Each ``@`` with the run of local characters before it and a dotted name after it; looks at each character a bounded number of times."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        j = at
        while j > low and text[j - 1] in LOCAL:
            j -= 1
        m = DOMAIN.match(text, at + 1) if j < at else None
        low = m.end() if m else at + 1
        if m:
            out.append((j, low))
        at = text.find("@", low)
    return out


def ips(text: str) -> list[Span]:
    """Within a maximal dotted run of numbers, matches take four numbers each from the left; one with a part over 255 is dropped."""
    out = []
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15] if "+" in text else []


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> dict[str, list[Span]]:
    return {k: DETECTORS[k](text) for k in KINDS}


# Letters that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n", "ԛ": "q", "ս": "u", "ν": "v", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}
# Digits in words, by language.
DIGITS = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
# Words for the signs, and which dot a bare at may go with ("look at the point" is no address).
AT_DOT = ((("at",), ("dot", "punkt")), (("arroba",), ("punto", "dot")), (("arobase", "arrobase"), ("point", "dot")))
PLUS_WORDS = ("plus", "más", "mas")
SPELLED = {word: str(k) for row in DIGITS for k, word in enumerate(row)} | {"fuenf": "5"}
AT_WORDS = tuple(w for ats, _ in AT_DOT for w in ats)
DOT_WORDS = tuple(dict.fromkeys(w for _, dots in AT_DOT for w in dots))

HOMOGLYPHS = {ord(k): v for k, v in LOOKALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
HOMOGLYPH = re.compile("[" + "".join(map(re.escape, map(chr, HOMOGLYPHS))) + "]")
_any = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_DIGIT = _any(SPELLED)
SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:{_DIGIT}|[0-9])(?:[\x20-](?:{_DIGIT}|[0-9](?![0-9])))*+[\x20-]{_DIGIT}(?:[\x20-](?:{_DIGIT}|[0-9](?![0-9])))*+(?![A-Za-z0-9])|(?<![A-Za-z0-9]){_DIGIT}(?:[\x20-](?:{_DIGIT}|[0-9](?![0-9])))++(?![A-Za-z0-9])", re.IGNORECASE)
SPELLED_WORD = re.compile(rf"{_DIGIT}|[0-9]", re.IGNORECASE)
BRACKET_AT = re.compile(rf"\x20?[\[({{<]\x20?(?:{_any(AT_WORDS)}|@)\x20?[\])}}>]\x20?", re.IGNORECASE)
BRACKET_DOT = re.compile(rf"\x20?[\[({{<]\x20?(?:{_any(DOT_WORDS)}|\.)\x20?[\])}}>]\x20?", re.IGNORECASE)
_NAME = rf"(?!{_any(DOT_WORDS)}(?![A-Za-z0-9-]))[A-Za-z0-9-]+"
_BARE_AT = "|".join(rf"{_any(ats)}\x20(?={_NAME}(?:\.{_NAME})*\x20{_any(dots)}\x20{_NAME})" for ats, dots in AT_DOT)
#: A bare at counts only where a spelled dot of its language and one more name follow the next one.
BARE = re.compile(rf"(?<=[A-Za-z0-9])\x20(?:(?P<at>{_BARE_AT})|{_any(DOT_WORDS)}\x20(?={_NAME}))", re.IGNORECASE)
PLUS = re.compile(rf"(?<![A-Za-z0-9]){_any(PLUS_WORDS)}\x20(?=\(?[0-9])", re.IGNORECASE)
#: Shortest run of spelled digits that is rewritten.
LEAST_SPELLED = 3


@dataclass
class Tape:
    """Characters with the span of the source that each came from; ``changed`` marks rewritten ones."""

    text: str
    start: list[int]
    end: list[int]
    changed: list[bool]

    @classmethod
    def of(cls, source: str) -> Tape:
        return cls(source, list(range(len(source))), list(range(1, len(source) + 1)), [False] * len(source))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace spans by texts; a replacement's characters share the replaced span, digit runs by word are given as edits of their own."""
        if not edits:
            return self
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            text.append(new)
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            changed += [True] * len(new)
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), start + self.start[at:], end + self.end[at:], changed + self.changed[at:])


def homoglyphs(tape: Tape) -> Tape:
    found = [(m.start(), m.end(), HOMOGLYPHS[ord(m.group())]) for m in HOMOGLYPH.finditer(tape.text)]
    return tape.rewrite(found)


def spelled_digits(tape: Tape) -> Tape:
    edits = []
    for run in SPELLED_RUN.finditer(tape.text):
        found = list(SPELLED_WORD.finditer(tape.text, run.start(), run.end()))
        if sum(len(w.group()) > 1 for w in found) < LEAST_SPELLED:
            continue
        at = run.start()
        for w in found:  # a separator goes with the word after it
            edits.append((w.start() if w is found[0] else at, w.end(), SPELLED.get(w.group().lower(), w.group())))
            at = w.end()
    return tape.rewrite(edits)


def signs(tape: Tape) -> Tape:
    """Disguised at and dot signs, then a spelled plus before digits."""
    for pattern, sign in ((BRACKET_AT, "@"), (BRACKET_DOT, ".")):
        tape = tape.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(tape.text)])
    tape = tape.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in BARE.finditer(tape.text)])
    return tape.rewrite([(m.start(), m.end(), "+") for m in PLUS.finditer(tape.text)])


#: Letters that patterns take for others when they ignore case.
_ODD_CASE = re.compile("[İıſ\u212a]")
_ASCII_WORD = re.compile("[a-z]+")
_ACCENTED = tuple(w for w in SPELLED if not w.isascii())


def _may_spell(low: str) -> bool:
    """Whether a text in lower case has enough spelled digits for a run."""
    found = sum(map(SPELLED.__contains__, _ASCII_WORD.findall(low)))
    return found >= LEAST_SPELLED or found + sum(map(low.count, _ACCENTED)) >= LEAST_SPELLED


def hidden(source: str) -> dict[str, list[Span]]:
    """Spans of the source that hold an identifier only after rewriting."""
    odd = not source.isascii() and HOMOGLYPH.search(source) is not None
    if not odd:
        # cheap tests for words that a pattern needs; each pattern is only left out where it can't match
        low = None if not source.isascii() and _ODD_CASE.search(source) else source.lower()
        has = lambda words: low is None or any(w in low for w in words)
        spelled = (low is None or _may_spell(low)) and SPELLED_RUN.search(source)
        if not (spelled or BRACKET_AT.search(source) or BRACKET_DOT.search(source) or has(DOT_WORDS) and BARE.search(source) or has(PLUS_WORDS) and PLUS.search(source)):
            return {}
    tape = signs(spelled_digits(homoglyphs(Tape.of(source))))
    if not any(tape.changed):
        return {}
    return {kind: spans for kind, found in detect(tape.text).items() if (spans := [(tape.start[a], tape.end[b - 1]) for a, b in found if any(tape.changed[a:b])])}


def scan(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base spans with those that the method adds, by kind, sorted by start. An added span that lies within a base one of its kind is left out."""
    text = text or ""
    base, more = detect(text), hidden(text)
    every = {}
    for kind in KINDS:
        starts = [a for a, _ in base[kind]]  # base spans of a kind don't overlap, so the last one that starts before tells
        added = [s for s in more.get(kind, ()) if not (k := bisect_right(starts, s[0])) or base[kind][k - 1][1] < s[1]]
        every[kind] = sorted({*base[kind], *added})
    return base, every


def render(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def mask(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are merged, the first kind named."""
    merged: list[list] = []
    for a, b, kind in sorted((a, b, KINDS.index(k)) for k in KINDS for a, b in spans[k]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in merged:
        out += [text[at:a], f"<{KINDS[kind]}>"]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", masked: bool = False) -> DataFrame:
    """One row per row: the id, counts of base spans by kind, the digest of base spans, all spans, how many were hidden, and with ``masked`` the masked text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in each(batch.column(1)):
                base, every = scan(t)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(render(base).encode()).hexdigest(), render(every), sum(map(len, every.values())) - sum(map(len, base.values())), *([mask(t or "", every)] if masked else [])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (7 + masked)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * masked
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", *names])

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden", *["masked"] * masked]
    kind = docs.schema[id_col].dataType.simpleString()
    types = ["long"] * 4 + ["string"] * 2 + ["long"] + ["string"] * masked
    schema = f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS t").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
