"""Compiles expression trees to Spark columns, with the semantics of the Lua subset: operand-valued ``and``/``or``, typed comparison, nil and failure.

``read_scope`` and ``site_scope`` name the variables. Functions that aren't offered raise ``UnsupportedExpression`` when compiled; there are no Python user
functions, except for printing floats in templates, after aggregation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import FLAGS, ExpressionError, UnsupportedExpression
from .language import names, parse
from .values import Value, always, choose, connected, either, never, opened

Scope = dict[str, tuple[str, Column]]
NUMBER = ("int", "float")


def number_text(value: float) -> str:
    """A float as Lua prints it."""
    if math.isnan(value):
        return "nan"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    out = f"{value:.14g}"
    return out if re.search(r"[.en]", out) else out + ".0"


@F.pandas_udf(StringType())
def _print_floats(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else number_text(v))


def text_of(kind: str, c: Column) -> Column:
    """``tostring`` of a value."""
    if kind == "int":
        return c.cast("string")
    if kind == "float":
        return _print_floats(c)
    if kind == "bool":
        return F.when(c, "true").otherwise("false")
    return F.lit("nil") if kind == "nil" else c


def java_pattern(pattern: str) -> str | None:
    """A POSIX extended pattern for Java's engine, or None if it is invalid."""
    names_ = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "blank": " \\t", "punct": r"\p{Punct}", "xdigit": "0-9A-Fa-f", "word": r"\w"}
    out = re.sub(r"\[:([a-z]+):\]", lambda m: names_.get(m.group(1), m.group(0)), pattern)
    out = re.sub(r"(?<!\\)\[(\^?)\]", lambda m: f"[{m.group(1)}\\]", out)
    try:
        re.compile(out.replace(r"\p{Punct}", "!"))
    except re.error:
        return None
    return out


def _float(c: Column) -> Column:
    return c.cast("double")


class Steps:
    """The parts of an expression as columns that the whole refers to by name, so that each is evaluated once: what only needs the read as columns of reads, the rest as columns
    of bases. Nested in each other they would be copied wherever a rule looks at a value twice, and make code that is too long to be compiled to machine code."""

    def __init__(self):
        self._reads: list[tuple[str, Column]] = []
        self._bases: list[tuple[str, Column]] = []

    def keep(self, v: Value, of_base: bool) -> Value:
        into, letter = (self._bases, "b") if of_base else (self._reads, "r")

        def one(c: Column | None) -> Column | None:
            if c is None:
                return None
            into.append((f"_step_{letter}{len(into)}", c))
            return F.col(into[-1][0])

        return Value([(one(condition), kind, one(c)) for condition, kind, c in v.alternatives], one(v.failed))

    def of_reads(self, reads: DataFrame) -> DataFrame:
        return _with_each(reads, self._reads)

    def of_bases(self, rows: DataFrame) -> DataFrame:
        return _with_each(rows, self._bases)


def _with_each(rows: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    for name, column in columns:
        rows = rows.withColumn(name, column)
    return rows


def _bits(node: tuple) -> int:
    """How many bits a whole number of an expression may have, with its sign: 64 unless it is known to be small."""
    if node[0] == "num" and isinstance(node[1], int):
        return node[1].bit_length() + 1
    if node[0] == "var":
        return 34
    if node[0] == "bin" and node[1] in ("+", "-", "*", "//", "%"):
        a, b = _bits(node[2]), _bits(node[3])
        return a + b if node[1] == "*" else max(a, b) + 1
    return 64


def _wrapped(c: Column) -> Column:
    """A decimal number as the whole number of 64 bits that is left of it."""
    half = F.lit(str(1 << 63)).cast("decimal(38,0)")
    return (F.pmod(c.cast("decimal(38,0)") + half, F.lit(str(1 << 64)).cast("decimal(38,0)")) - half).cast("bigint")


class Compiler:
    """``tags`` gives the column of a tag by its name; None where there are no tags. With ``steps``, parts become columns of their own."""

    def __init__(self, scope: Scope, tags: Callable[[str], Column] | None = None, steps: Steps | None = None):
        self.scope, self.tags, self.steps = scope, tags, steps
        self._kept: dict[str, Value] = {}

    def compile(self, node: tuple) -> Value:
        if self.steps is None or node[0] in ("num", "str", "bool", "nil"):
            return getattr(self, f"_{node[0]}")(*node[1:])
        key = repr(node)
        if key not in self._kept:
            self._kept[key] = self.steps.keep(getattr(self, f"_{node[0]}")(*node[1:]), by_base(node))
        return self._kept[key]

    def kept(self, key: tuple, v: Value, node: tuple) -> Value:
        """A part that is no node of its own, made of ``node``: evaluated once, too, where there are steps."""
        if self.steps is None:
            return v
        if repr(key) not in self._kept:
            self._kept[repr(key)] = self.steps.keep(v, by_base(node))
        return self._kept[repr(key)]

    def _num(self, v) -> Value:
        return Value.of("int", F.lit(v).cast("bigint")) if isinstance(v, int) else Value.of("float", F.lit(float(v)))

    def _str(self, v: str) -> Value:
        return Value.of("str", F.lit(v))

    def _bool(self, v: bool) -> Value:
        return Value.of("bool", F.lit(v))

    def _nil(self) -> Value:
        return Value.of("nil")

    def _var(self, name: str) -> Value:
        short = re.sub(r"^(read|pile)\.", "", name)
        if short in self.scope:
            kind, column = self.scope[short]
            return Value.of(kind, column)
        if short in FLAGS or short.lower() in FLAGS and short.isupper():
            return Value.of("int", F.lit(FLAGS[short.lower()]).cast("bigint"))
        if short == "math.pi":
            return Value.of("float", F.lit(math.pi))
        if short == "math.huge":
            return Value.of("float", F.lit(float("inf")))
        if short in FUNCTIONS or short.split(".")[0] in ("io", "os", "package", "debug", "coroutine", "utf8", "string", "math"):
            raise UnsupportedExpression(f"{name} can't be used here")
        return Value.of("nil")

    def _un(self, op: str, a: tuple) -> Value:
        v = self.compile(a)
        if op == "not":
            return Value.of("bool", ~v.truthy(), v.failed)
        v = opened(v)
        if op == "-":
            return v.map(lambda k, c: Value.of(k, -c) if k in NUMBER else self._numeric(k, c, lambda x: Value.of("float", -x)))
        if op == "#":
            return v.map(lambda k, c: Value.of("int", F.octet_length(c).cast("bigint")) if k == "str" else self._fail("int"))
        return v.map(lambda k, c: self._whole(k, c, lambda x: Value.of("int", F.bitwise_not(x))))

    def _bin(self, op: str, a: tuple, b: tuple) -> Value:
        x, y = self.compile(a), self.compile(b)
        if op in ("and", "or"):
            return connected(x, y, op)
        x, y = opened(x), opened(y)
        wide = max(_bits(a), _bits(b), _bits(("bin", op, a, b))) > 63
        above = b[0] == "num" and isinstance(b[1], int) and b[1] > 0
        return x.map(lambda k, c: self._after(y, lambda j, d: self._apply(op, k, c, j, d, wide, above)))

    @staticmethod
    def _after(y: Value, f: Callable) -> Value:
        return y.map(f)

    def _fail(self, kind: str) -> Value:
        empty = {"int": F.lit(0).cast("bigint"), "float": F.lit(0.0), "bool": never(), "str": F.lit("")}[kind]
        return Value.of(kind, empty, always())

    def _numeric(self, kind: str, c: Column | None, f: Callable[[Column], Value], out: str = "float") -> Value:
        """A text that is a number counts as one; anything else fails."""
        if kind in NUMBER:
            return f(_float(c))
        if kind != "str":
            return self._fail(out)
        n = F.trim(c).try_cast("double")
        v = f(F.coalesce(n, F.lit(0.0)))
        return Value(v.alternatives, either(n.isNull(), v.failed))

    def _whole(self, kind: str, c: Column | None, f: Callable[[Column], Value]) -> Value:
        """A number with an integral value; anything else fails."""
        if kind == "int":
            return f(c)
        if kind not in ("float", "str"):
            return self._fail("int")
        n = F.trim(c).try_cast("double") if kind == "str" else c
        good = F.coalesce((n == F.floor(n)) & (F.abs(n) < 9.2e18), never())
        v = f(F.when(good, n.cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return Value(v.alternatives, either(~good, v.failed))

    def _apply(self, op: str, k: str, c: Column | None, j: str, d: Column | None, wide: bool = True, above: bool = False) -> Value:
        """``wide`` if whole numbers may go beyond 64 bits, where they wrap around; ``above`` if the right one is above 0."""
        if op in ("==", "~="):
            if k in NUMBER and j in NUMBER:
                same = c == d if k == j else _float(c) == _float(d)
                if "float" in (k, j):  # Spark holds NaN equal to itself
                    same = same & ~F.isnan(_float(c))
            elif k == j:
                same = always() if k == "nil" else c == d
            else:
                same = never()
            return Value.of("bool", same if op == "==" else ~same)
        if op in ("<", ">", "<=", ">="):
            if not (k in NUMBER and j in NUMBER) and not (k == j == "str"):
                return self._fail("bool")
            if k != j:
                c, d = _float(c), _float(d)
            out = {"<": lambda: c < d, ">": lambda: c > d, "<=": lambda: c <= d, ">=": lambda: c >= d}[op]()
            if "float" in (k, j):  # and NaN above everything
                out = out & ~F.isnan(_float(c)) & ~F.isnan(_float(d))
            return Value.of("bool", out)
        if op == "..":
            if k in ("bool", "nil") or j in ("bool", "nil"):
                return self._fail("str")
            return Value.of("str", F.concat(text_of(k, c), text_of(j, d)))
        if op in ("&", "|", "~", "<<", ">>"):
            return self._whole(k, c, lambda x: self._whole(j, d, lambda y: Value.of("int", self._bits(op, x, y))))
        if k == j == "int" and op in ("+", "-", "*"):
            plain = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
            if not wide:
                return Value.of("int", plain(c, d))
            tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](c, d)
            long = lambda x: x.cast("decimal(19,0)")
            return Value.of("int", F.coalesce(tried, _wrapped(plain(long(c), long(d)))))
        if k == j == "int" and op in ("//", "%") and above:
            left = F.pmod(c, d)
            return Value.of("int", left if op == "%" else F.call_function("div", c - left, d))
        if k == j == "int" and op in ("//", "%"):
            zero = d == 0
            by = F.when(zero, F.lit(1).cast("bigint")).otherwise(d)
            left = c % by
            left = F.when((left != 0) & ((left < 0) != (by < 0)), left + by).otherwise(left)
            return Value.of("int", left if op == "%" else F.call_function("div", c - left, by), zero)
        return self._numeric(k, c, lambda x: self._numeric(j, d, lambda y: Value.of("float", self._arithmetic(op, x, y))))

    @staticmethod
    def _bits(op: str, x: Column, y: Column) -> Column:
        if op in ("<<", ">>"):
            n = y if op == "<<" else -y
            up = F.call_function("shiftleft", x, F.least(n, F.lit(63)).cast("int"))
            down = F.call_function("shiftrightunsigned", x, F.least(-n, F.lit(63)).cast("int"))
            return F.when(F.abs(n) >= 64, F.lit(0).cast("bigint")).when(n >= 0, up).otherwise(down)
        return {"&": x.bitwiseAND, "|": x.bitwiseOR, "~": x.bitwiseXOR}[op](y)

    @staticmethod
    def _arithmetic(op: str, x: Column, y: Column) -> Column:
        if op in ("+", "-", "*"):
            return {"+": x + y, "-": x - y, "*": x * y}[op]
        if op == "^":
            return F.pow(x, y)
        by = F.when(y == 0, F.lit(1.0)).otherwise(y)
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        if op == "%":
            left = x % by
            left = F.when((left != 0) & ((left < 0) != (by < 0)), left + by).otherwise(left)
            return F.when(y == 0, nan).otherwise(left)
        over = F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)
        quotient = x / by
        return F.when(y == 0, over).otherwise(quotient if op == "/" else F.floor(quotient).cast("double"))

    def _call(self, name: str, args: list[tuple]) -> Value:
        short = re.sub(r"^(read|pile)\.", "", name)
        if short in ("tag", "exists"):
            if self.tags is None:
                raise UnsupportedExpression(f"{short} needs a read")
            if len(args) != 1 or args[0][0] != "str":
                raise UnsupportedExpression(f"{short} needs a quoted name")
            key = args[0][1]
            value = self.tags(key) if len(key) == 2 else None
            if short == "exists":
                return Value.of("bool", never() if value is None else F.coalesce(value.isNotNull(), never()))
            return Value.of("nil") if value is None else Value.of("tag", F.when(value["t"] != "B", value))  # arrays are there, but have no value
        if short in ("re_match", "re_find"):
            if len(args) != 2 or args[1][0] != "str":
                raise UnsupportedExpression(f"{short} needs a quoted pattern")
            pattern = java_pattern(args[1][1])
            v = opened(self.compile(args[0]))
            return v.map(lambda k, c: self._fail("bool") if k in ("nil", "bool") else Value.of("bool", never() if pattern is None else text_of(k, c).rlike(pattern)))
        from .strings import BY_LITERAL  # it builds on this module

        if short in BY_LITERAL:
            return BY_LITERAL[short](self, args)
        if short not in FUNCTIONS:
            raise UnsupportedExpression(f"unknown function {name!r}")
        return FUNCTIONS[short](self, [self.opened(a) for a in args])

    def opened(self, node: tuple) -> Value:
        return opened(self.compile(node))

    def each(self, values: list[Value], f: Callable[..., Value]) -> Value:
        """Apply f to (kind, column) of every argument, over all alternatives."""
        if not values:
            return f()
        return values[0].map(lambda k, c: self.each(values[1:], lambda *rest: f((k, c), *rest)))


def _math(f: Callable[[Column], Column], domain: Callable[[Column], Column] | None = None):
    def run(self: Compiler, values: list[Value]) -> Value:
        if len(values) != 1:
            raise ExpressionError("one argument is needed")

        def one(x: Column) -> Value:
            y = f(x)
            return Value.of("float", F.coalesce(y, F.lit(float("nan"))) if domain is None else domain(x))

        return values[0].map(lambda k, c: self._numeric(k, c, one))

    return run


def _log(self: Compiler, values: list[Value]) -> Value:
    ln = lambda x: F.when(x > 0, F.ln(F.when(x > 0, x).otherwise(1.0))).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    if len(values) == 2:
        return self.each(values, lambda a, b: self._numeric(*a, lambda x: self._numeric(*b, lambda y: Value.of("float", ln(x) / ln(y)))))
    return values[0].map(lambda k, c: self._numeric(k, c, lambda x: Value.of("float", ln(x))))


def _power(self: Compiler, values: list[Value]) -> Value:
    return self.each(values[:2], lambda a, b: self._numeric(*a, lambda x: self._numeric(*b, lambda y: Value.of("float", F.pow(x, y)))))


def _round(self: Compiler, values: list[Value]) -> Value:
    """Half up, as a float."""
    digits = values[1] if len(values) > 1 else Value.of("int", F.lit(0).cast("bigint"))

    def run(a, n):
        return self._numeric(*a, lambda x: self._numeric(*n, lambda y: Value.of("float", F.floor(x * F.pow(F.lit(10.0), y) + 0.5).cast("double") / F.pow(F.lit(10.0), y))))

    return self.each([values[0], digits], run)


def _int(self: Compiler, values: list[Value]) -> Value:
    """Toward zero, as a float."""
    return values[0].map(lambda k, c: self._numeric(k, c, lambda x: Value.of("float", F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))))


def _floorlike(f: Callable[[Column], Column]):
    def run(self: Compiler, values: list[Value]) -> Value:
        return values[0].map(lambda k, c: Value.of("int", c) if k == "int" else self._numeric(k, c, lambda x: Value.of("int", f(x).cast("bigint")), "int"))

    return run


def _abs(self: Compiler, values: list[Value]) -> Value:
    return values[0].map(lambda k, c: Value.of(k, F.abs(c)) if k in NUMBER else self._numeric(k, c, lambda x: Value.of("float", F.abs(x))))


def _extreme(pick: Callable, of_text: Callable):
    """``min``/``max``: of a text's bytes with one text argument, else of numbers."""

    def run(self: Compiler, values: list[Value]) -> Value:
        if len(values) == 1 and values[0].kind in ("str", "bytes"):
            return values[0].map(lambda k, c: of_text(self, k, c))

        def numbers(*args):
            if all(k == "int" for k, _ in args):
                return Value.of("int", pick(*[c for _, c in args]) if len(args) > 1 else args[0][1])
            if all(k in NUMBER for k, _ in args):
                return Value.of("float", pick(*[_float(c) for _, c in args]) if len(args) > 1 else _float(args[0][1]))
            return self._fail("float")

        return self.each(values, numbers)

    return run


def _bytes(kind: str, c: Column) -> Column:
    """The bytes of a text, or the numbers of a quality string."""
    if kind == "bytes":
        return c
    hexes = F.hex(F.encode(c, "UTF-8"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.octet_length(c) - 1, F.lit(0))), lambda i: F.octet_length(c) > 0)
    return F.transform(places, lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _byte_extreme(f: Callable[[Column], Column]):
    def run(self: Compiler, kind: str, c: Column) -> Value:
        return Value.of("int", F.coalesce(f(_bytes(kind, c)), F.lit(-1)).cast("bigint")) if kind in ("str", "bytes") else self._fail("int")

    return run


def _text(f: Callable[[str, Column], Value]):
    def run(self: Compiler, values: list[Value]) -> Value:
        return values[0].map(lambda k, c: f(k, c) if k in ("str", "bytes") else f("str", text_of(k, c)) if k in NUMBER else self._fail("str"))

    return run


def _length(self: Compiler, values: list[Value]) -> Value:
    return _text(lambda k, c: Value.of("int", (F.size(c) if k == "bytes" else F.octet_length(c)).cast("bigint")))(self, values)


def _mean(self: Compiler, values: list[Value]) -> Value:
    def run(k, c):
        b = _bytes(k, c)
        return Value.of("float", F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(b), F.lit(1))).otherwise(F.lit(float("nan"))))

    return _text(run)(self, values)


def _n_part(from_end: bool):
    """The number of N among the first or last n bases, over the whole read's length."""

    def run(self: Compiler, values: list[Value]) -> Value:
        _, seq = self.scope["seq"]
        size = F.length(seq)

        def part(x: Column) -> Value:
            n = F.least(F.greatest(x, F.lit(0)), size.cast("bigint")).cast("int")
            piece = F.substring(seq, size - n + 1, n) if from_end else F.substring(seq, F.lit(1), n)
            count = n - F.length(F.translate(piece, "N", ""))
            return Value.of("float", F.when(size > 0, count / F.greatest(size, F.lit(1))).otherwise(0.0))

        return values[0].map(lambda k, c: self._whole(k, c, part))

    return run


def _sub(self: Compiler, values: list[Value]) -> Value:
    last = values[2] if len(values) > 2 else Value.of("int", F.lit(-1).cast("bigint"))

    def run(s, i, j):
        if s[0] != "str":
            return self._fail("str")
        n = F.length(s[1]).cast("bigint")

        def cut(a, b):
            a = F.when(a < 0, F.greatest(n + a + 1, F.lit(1))).when(a == 0, F.lit(1)).otherwise(a)
            b = F.when(b < 0, n + b + 1).otherwise(F.least(b, n))
            return Value.of("str", F.when(b >= a, F.substring(s[1], a.cast("int"), (b - a + 1).cast("int"))).otherwise(""))

        return self._whole(*i, lambda a: self._whole(*j, lambda b: cut(a, b)))

    return self.each([values[0], values[1], last], run)


def _byte(self: Compiler, values: list[Value]) -> Value:
    at = values[1] if len(values) > 1 else Value.of("int", F.lit(1).cast("bigint"))

    def run(s, i):
        if s[0] not in ("str", "bytes"):
            return self._fail("int")
        b = _bytes(*s)
        return self._whole(*i, lambda x: choose((F.abs(x) >= 1) & (F.abs(x) <= F.size(b)), Value.of("int", F.try_element_at(b, F.when(x == 0, 1).otherwise(x).cast("int")).cast("bigint")), Value.of("nil")))

    return self.each([values[0], at], run)


def _repeat(self: Compiler, values: list[Value]) -> Value:
    return self.each(values[:2], lambda s, n: self._whole(*n, lambda x: Value.of("str", F.repeat(s[1], F.greatest(x, F.lit(0)).cast("int")))) if s[0] == "str" else self._fail("str"))


def _char(self: Compiler, values: list[Value]) -> Value:
    """The text of ASCII codes; others fail."""

    def run(*args):
        def joined(done: list[Column], rest: list, bad: Column) -> Value:
            if not rest:
                return Value.of("str", F.concat(F.lit(""), *done), bad)
            return self._whole(*rest[0], lambda x: joined([*done, F.call_function("char", F.when((x >= 0) & (x < 128), x).otherwise(32))], rest[1:], bad | (x < 0) | (x > 127)))

        return joined([], list(args), never())

    return self.each(values, run)


def _below(self: Compiler, values: list[Value]) -> Value:
    """Whether one whole number is below another, both taken as without a sign."""
    least = F.lit(-(1 << 63)).cast("bigint")
    return self.each(values[:2], lambda a, b: self._whole(*a, lambda x: self._whole(*b, lambda y: Value.of("bool", x.bitwiseXOR(least) < y.bitwiseXOR(least)))))


def _whole_part(self: Compiler, values: list[Value]) -> Value:
    """Toward zero; a whole number stays one, others give a float."""
    return values[0].map(lambda k, c: Value.of("int", c) if k == "int" else self._numeric(k, c, lambda x: Value.of("float", F.when(F.abs(x) == float("inf"), x).when(x < 0, F.ceil(x).cast("double")).otherwise(F.floor(x).cast("double")))))


def _tostring(self: Compiler, values: list[Value]) -> Value:
    return values[0].map(lambda k, c: Value.of("str", text_of(k, c)))


def _tonumber(self: Compiler, values: list[Value]) -> Value:
    def run(k, c):
        if k in NUMBER:
            return Value.of(k, c)
        if k != "str":
            return Value.of("nil")
        whole, real = F.trim(c).try_cast("bigint"), F.trim(c).try_cast("double")
        integral = F.trim(c).rlike("^[+-]?[0-9]+$") & whole.isNotNull()
        return Value([(integral, "int", whole), (real.isNotNull(), "float", real), (None, "nil", None)])

    return values[0].map(run)


def _type(self: Compiler, values: list[Value]) -> Value:
    word = {"int": "number", "float": "number", "str": "string", "bytes": "string", "bool": "boolean", "nil": "nil"}
    return values[0].map(lambda k, c: Value.of("str", F.lit(word[k])))


def _kind_of_number(self: Compiler, values: list[Value]) -> Value:
    return values[0].map(lambda k, c: Value.of("str", F.lit({"int": "integer", "float": "float"}[k])) if k in NUMBER else Value.of("nil"))


def _tointeger(self: Compiler, values: list[Value]) -> Value:
    def run(k, c):
        if k == "int":
            return Value.of("int", c)
        if k != "float":
            return Value.of("nil")
        good = (c == F.floor(c)) & (F.abs(c) < 9.2e18)
        return choose(good, Value.of("int", F.when(good, c).otherwise(0.0).cast("bigint")), Value.of("nil"))

    return values[0].map(run)


def _fmod(self: Compiler, values: list[Value]) -> Value:
    def run(a, b):
        if a[0] == b[0] == "int":
            return Value.of("int", a[1] % F.when(b[1] == 0, F.lit(1).cast("bigint")).otherwise(b[1]), b[1] == 0)
        return self._numeric(*a, lambda x: self._numeric(*b, lambda y: Value.of("float", F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y == 0, 1.0).otherwise(y)))))

    return self.each(values[:2], run)


def _string(f: Callable[[Column], Column]):
    return _text(lambda k, c: Value.of("str", f(c)))


def _sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(F.greatest(x, F.lit(0.0)))).otherwise(F.lit(float("nan")))


FUNCTIONS: dict[str, Callable] = {
    "sqrt": _math(_sqrt), "exp": _math(F.exp), "log": _log, "pow": _power, "round": _round, "int": _int,
    "math.sqrt": _math(_sqrt), "math.exp": _math(F.exp), "math.log": _log, "math.pow": _power, "math.abs": _abs, "math.floor": _floorlike(F.floor), "math.ceil": _floorlike(F.ceil),
    "math.sin": _math(F.sin), "math.cos": _math(F.cos), "math.tan": _math(F.tan), "math.asin": _math(F.asin), "math.acos": _math(F.acos), "math.atan": _math(F.atan),
    "math.deg": _math(F.degrees), "math.rad": _math(F.radians), "math.log10": _math(lambda x: F.log10(x)), "math.cosh": _math(F.cosh), "math.sinh": _math(F.sinh), "math.tanh": _math(F.tanh),
    "math.fmod": _fmod, "math.tointeger": _tointeger, "math.type": _kind_of_number,
    "math.min": _extreme(F.least, _byte_extreme(F.array_min)), "math.max": _extreme(F.greatest, _byte_extreme(F.array_max)),
    "min": _extreme(F.least, _byte_extreme(F.array_min)), "max": _extreme(F.greatest, _byte_extreme(F.array_max)),
    "smin": _extreme(F.least, _byte_extreme(F.array_min)), "smax": _extreme(F.greatest, _byte_extreme(F.array_max)),
    "savg": _mean, "avg": _mean, "slen": _length, "length": _length, "string.len": _length,
    "n5": _n_part(False), "n3": _n_part(True), "n_proportion_5_prime": _n_part(False), "n_proportion_3_prime": _n_part(True),
    "string.lower": _string(F.lower), "string.upper": _string(F.upper), "string.reverse": _string(F.reverse), "string.rep": _repeat, "string.sub": _sub, "string.byte": _byte, "string.char": _char, "math.ult": _below, "math.modf": _whole_part,
    "tostring": _tostring, "tonumber": _tonumber, "type": _type,
}


def tag_names(node: tuple) -> set[str]:
    """Tags that a tree reads."""
    if node[0] == "call":
        own = {node[2][0][1]} if node[1].split(".")[-1] in ("tag", "exists") and node[2] and node[2][0][0] == "str" else set()
        return own.union(*(tag_names(a) for a in node[2]))
    return set().union(*(tag_names(a) for a in node[1:] if isinstance(a, tuple)))


def compile_expression(source: str, scope: Scope, tags: Callable[[str], Column] | None = None) -> Value:
    return Compiler(scope, tags).compile(parse(source))


def passes(value: Value) -> Column:
    """Whether a filter keeps the row: it didn't fail, and is neither nil nor false."""
    return F.coalesce(value.truthy() & ~value.fails(), never())


def slot(value: Value) -> Column:
    """The group that a router sends a base to, 0 to 3, or null: true is 0, whole numbers are themselves, other numbers are 0."""

    def one(kind: str, c: Column | None) -> Column:
        none = F.lit(None).cast("int")
        if kind == "bool":
            return F.when(c, F.lit(0))
        if kind == "nil":
            return none
        n = F.trim(c).try_cast("double") if kind == "str" else c
        whole = F.when(n == F.floor(n), n).when(n.isNotNull(), F.lit(0)) if kind != "int" else n
        return F.when((whole >= 0) & (whole < 4), whole.cast("int")).otherwise(none)

    v = opened(value)
    return F.when(~v.fails(), v.pick(one))


#: Variables that differ between the bases of a read.
PER_BASE = frozenset("qpos QPOS bq BQ baseq base BASE ref REF dist5 DIST5 distance_from_5prime dist3 DIST3 distance_from_3prime".split())


def by_base(node: tuple) -> bool:
    return any(n.split(".")[-1] in PER_BASE for n in names(node))


def uses_reference(node: tuple) -> bool:
    return any(n.split(".")[-1] in ("ref", "REF") for n in names(node))


__all__ = ["Compiler", "by_base", "compile_expression", "passes", "slot", "uses_reference"]
