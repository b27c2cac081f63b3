"""Functions of texts whose pattern or format is written out in the expression: translated to Java's patterns and formats when compiled."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ExpressionError, UnsupportedExpression
from .compiler import NUMBER, Compiler, text_of
from .values import Value, choose

MAGIC = "^$*+?.([%-"
# The letters that stand for classes, as Java writes them inside of brackets.
CLASSES = {"a": "a-zA-Z", "d": "0-9", "l": "a-z", "u": "A-Z", "w": "a-zA-Z0-9", "x": "0-9A-Fa-f", "s": r"\x20\t-\r", "p": r"\p{Punct}", "c": r"\x00-\x1f\x7f", "g": r"\x21-\x7e"}


def _one(letter: str) -> str:
    return f"[{'' if letter.islower() else '^'}{CLASSES[letter.lower()]}]" if letter.lower() in CLASSES else re.escape(letter)


def _brackets(pattern: str, k: int) -> tuple[str, int]:
    """The set that starts after the bracket at k, and the place after it."""
    negated, k = (True, k + 2) if pattern[k + 1 : k + 2] == "^" else (False, k + 1)
    parts, first = [], True
    while first or pattern[k : k + 1] != "]":
        if k >= len(pattern):
            raise ExpressionError("a set has no end")
        if pattern[k] == "%" and k + 1 < len(pattern):
            letter = pattern[k + 1]
            parts.append(_one(letter) if letter.lower() in CLASSES else re.escape(letter))
            k += 2
        elif pattern[k + 1 : k + 2] == "-" and pattern[k + 2 : k + 3] not in ("]", ""):
            parts.append(f"{re.escape(pattern[k])}-{re.escape(pattern[k + 2])}")
            k += 3
        else:
            parts.append(re.escape(pattern[k]).replace("&", r"\&"))
            k += 1
        first = False
    return f"[{'^' if negated else ''}{''.join(parts)}]", k + 1


def pattern_of(pattern: str) -> tuple[str, int]:
    """Java's pattern, and how many captures it has. Balanced pairs, frontiers, back references and captures of places aren't offered."""
    out, k, captures, depth = [], 0, 0, 0
    if pattern.startswith("^"):
        out.append("^")
        k = 1
    while k < len(pattern):
        c = pattern[k]
        if c == "(":
            if pattern[k + 1 : k + 2] == ")":
                raise UnsupportedExpression("captures of places aren't offered")
            out.append("(")
            captures, depth, k = captures + 1, depth + 1, k + 1
            continue
        if c == ")":
            if not depth:
                raise ExpressionError("a capture has no start")
            out.append(")")
            depth, k = depth - 1, k + 1
            continue
        if c == "$" and k + 1 == len(pattern):
            out.append(r"\z")
            break
        if c == "%":
            letter = pattern[k + 1 : k + 2]
            if not letter:
                raise ExpressionError("a pattern ends with %")
            if letter in "bf" or letter.isdigit():
                raise UnsupportedExpression(f"%{letter} isn't offered in patterns")
            one, k = _one(letter), k + 2
        elif c == "[":
            one, k = _brackets(pattern, k)
        else:
            one, k = ("." if c == "." else re.escape(c)), k + 1
        if pattern[k : k + 1] and pattern[k] in "*+?-":
            one += "*?" if pattern[k] == "-" else pattern[k]
            k += 1
        out.append(one)
    if depth:
        raise ExpressionError("a capture has no end")
    return "(?s)" + "".join(out), captures


def _literal(args: list[tuple], k: int, what: str) -> str:
    if len(args) <= k or args[k][0] != "str":
        raise UnsupportedExpression(f"{what} has to be written out")
    return args[k][1]


def _from(self: Compiler, s: Column, init: Value | None, f: Callable[[Column, Column], Value]) -> Value:
    """f of the rest of a text from ``init`` on, and where it starts (from 0); nil where that is beyond the end."""
    if init is None:
        return f(s, F.lit(0))

    def run(i: Column) -> Value:
        n = F.length(s).cast("bigint")
        start = F.when(i > 0, i - 1).when(i == 0, 0).otherwise(F.greatest(n + i, F.lit(0)))
        rest = F.substring(s, (F.least(start, n) + 1).cast("int"), F.lit(1 << 30))
        return choose(start <= n, f(rest, start), Value.of("nil"))

    return init.map(lambda k, c: self._whole(k, c, run))


def _text(self: Compiler, k: str, c: Column, f: Callable[[Column], Value]) -> Value:
    return f(c if k == "str" else text_of(k, c)) if k == "str" or k in NUMBER else self._fail("str")


def find(self: Compiler, args: list[tuple]) -> Value:
    """The first place, or nil. A pattern has to be written out, plain text (a true fourth argument, or nothing magic in it) need not be."""
    plain = len(args) > 3 and args[3] == ("bool", True)
    if len(args) < 2 or len(args) > 3 and args[3][0] != "bool":
        raise UnsupportedExpression("string.find needs a text, a pattern, and true or false for plain text")
    if not plain and not any(c in MAGIC for c in _literal(args, 1, "a pattern")):
        plain = True
    init = self.opened(args[2]) if len(args) > 2 else None
    pattern = None if plain else pattern_of(args[1][1])[0]

    def at(place: Column, start: Column) -> Value:
        return choose(place > 0, Value.of("int", (place + start).cast("bigint")), Value.of("nil"))

    def run(s: Column, p: Column | None) -> Value:
        if p is not None:
            return _from(self, s, init, lambda rest, start: at(F.call_function("locate", p, rest), start))
        before = r"(?s)^()" if pattern.startswith("(?s)^") else r"(?s)^(.*?)"
        place = lambda rest: F.when(rest.rlike(pattern), F.length(F.regexp_extract(rest, f"{before}(?:{pattern})", 1)) + 1).otherwise(0)
        return _from(self, s, init, lambda rest, start: at(place(rest), start))

    s = self.opened(args[0])
    if not plain:
        return s.map(lambda k, c: _text(self, k, c, lambda x: run(x, None)))
    p = self.opened(args[1])
    return self.each([s, p], lambda a, b: _text(self, *a, lambda x: _text(self, *b, lambda y: run(x, y))))


def match(self: Compiler, args: list[tuple]) -> Value:
    """The first capture, or all that matches without one; nil for no match."""
    pattern, captures = pattern_of(_literal(args, 1, "a pattern"))
    init = self.opened(args[2]) if len(args) > 2 else None
    found = lambda rest, _: choose(rest.rlike(pattern), Value.of("str", F.regexp_extract(rest, pattern, min(captures, 1))), Value.of("nil"))
    return self.opened(args[0]).map(lambda k, c: _text(self, k, c, lambda s: _from(self, s, init, found)))


def gsub(self: Compiler, args: list[tuple]) -> Value:
    """The text with each match replaced; the replacement is written out, with %0 to %9 for captures."""
    pattern, captures = pattern_of(_literal(args, 1, "a pattern"))
    new = _literal(args, 2, "a replacement")
    if len(args) != 3:
        raise UnsupportedExpression("string.gsub replaces all matches")

    def part(m: re.Match) -> str:
        if m.group(1) is None:
            return re.sub(r"([\\$])", r"\\\1", m.group())
        if m.group(1).isdigit():
            if int(m.group(1)) > max(1, captures):
                raise ExpressionError(f"there is no capture {m.group()}")
            return "$" + (m.group(1) if captures else "0")
        if m.group(1) == "%":
            return "%"
        raise ExpressionError(f"{m.group()} can't be in a replacement")

    java = re.sub(r"%(.)|[^%]", part, new)
    return self.opened(args[0]).map(lambda k, c: _text(self, k, c, lambda s: Value.of("str", F.regexp_replace(s, F.lit(pattern), F.lit(java)))))


_SPEC = re.compile(r"%([-+ #0]*)(\d{0,2})(?:\.(\d{0,2}))?([a-zA-Z%])")


def format_text(self: Compiler, args: list[tuple]) -> Value:
    """C's formats d, i, u, x, X, o, c, f, e, E and s, each with flags, width and precision."""
    template = _literal(args, 0, "a format")
    values, fields, between, at = [self.opened(a) for a in args[1:]], [], [""], 0
    for m in _SPEC.finditer(template):
        between[-1] += template[at : m.start()]
        at = m.end()
        flags, width, digits, kind = m.groups()
        if kind == "%":
            between[-1] += "%"
            continue
        if kind not in "diuxXocfeEs":
            raise UnsupportedExpression(f"%{kind} isn't offered in formats")
        point = f".{digits or 0}" if digits is not None and kind in "feEs" else ""
        fields.append((kind, f"%{flags}{width}{point}{ {'i': 'd', 'u': 'd'}.get(kind, kind)}"))
        between.append("")
    if "%" in template[at:]:
        raise ExpressionError("a format ends within a field")
    between[-1] += template[at:]
    if len(values) < len(fields):
        raise ExpressionError("a format has more fields than there are values")

    def printed(kind: str, java: str, k: str, c: Column | None) -> Value:
        one = lambda x: Value.of("str", F.format_string(java, x))
        if kind == "s":
            return Value.of("str", F.coalesce(text_of(k, c), F.lit("null"))) if java == "%s" else one(text_of(k, c))
        return self._numeric(k, c, one, "str") if kind in "feE" else self._whole(k, c, lambda x: one(x.cast("int") if kind == "c" else x))

    def field(spec: tuple[str, str], v: Value, node: tuple) -> Value:
        return self.kept(("field", *spec, node), v.map(lambda k, c: printed(*spec, k, c)), node)

    parts = [field(spec, v, node) for spec, v, node in zip(fields, values, args[1:])]
    return self.each(parts, lambda *found: Value.of("str", F.concat(F.lit(between[0]), *[x for (_, c), text in zip(found, between[1:]) for x in (c, F.lit(text))])))


BY_LITERAL: dict[str, Callable[[Compiler, list[tuple]], Value]] = {"string.find": find, "string.match": match, "string.gsub": gsub, "string.format": format_text}
