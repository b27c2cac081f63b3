"""Lexer and parser of the expression language: a subset of Lua with a little sugar.

``!=`` is ``~=``, ``!`` is ``not``, ``&&`` and ``||`` are ``and`` and ``or``; ``[XX]`` is the tag XX; ``flag.dup`` is the masked flag; ``name =~ "re"`` and
``!~`` are searches. Nodes are tuples: ("num", v), ("str", v), ("bool", v), ("nil",), ("var", name), ("call", name, args), ("un", op, a), ("bin", op, a, b).
"""

from __future__ import annotations

import re

from ..schema import FLAGS, ExpressionError

TOKEN = re.compile(
    r"""\s*(?:
      (?P<num>0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    | (?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    | (?P<tag>\[[A-Za-z][A-Za-z0-9]\])
    | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)
    | (?P<op>&&|\|\||=~|!~|==|~=|!=|<=|>=|<<|>>|//|\.\.|[-+*/%^\#<>()&|~!,:])
    )""",
    re.VERBOSE,
)
SUGAR = {"&&": "and", "||": "or", "!=": "~=", "!": "not"}
# Binding strengths (left, right), weakest first as in Lua.
BINARY = {
    "or": (1, 1), "and": (2, 2), "<": (3, 3), ">": (3, 3), "<=": (3, 3), ">=": (3, 3), "~=": (3, 3), "==": (3, 3), "|": (4, 4), "~": (5, 5), "&": (6, 6),
    "<<": (7, 7), ">>": (7, 7), "..": (9, 8), "+": (10, 10), "-": (10, 10), "*": (11, 11), "/": (11, 11), "//": (11, 11), "%": (11, 11), "^": (14, 13),
}
UNARY = 12
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unescape(body: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(0)), body, flags=re.DOTALL)


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m or m.end() == at:
            raise ExpressionError(f"unexpected text at {source[at : at + 12]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "op" and value in SUGAR:
            value = SUGAR[value]
            kind = "name" if value in ("and", "or", "not") else "op"
        out.append((kind, value))
        at = m.end()
    return out


class Parser:
    def __init__(self, source: str):
        self.tokens, self.at = tokens(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def expect(self, value: str) -> None:
        if self.take()[1] != value:
            raise ExpressionError(f"expected {value!r}")

    def parse(self) -> tuple:
        if self.peek() == ("name", "return"):
            self.take()
        node = self.expression(0)
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return node

    def operator(self) -> str | None:
        kind, value = self.peek()
        if kind == "op" and (value in BINARY or value in ("=~", "!~")):
            return value
        return value if kind == "name" and value in ("and", "or") else None

    def expression(self, least: int) -> tuple:
        kind, value = self.peek()
        if (kind, value) == ("name", "not") or kind == "op" and value in ("-", "#", "~"):
            self.take()
            left = ("un", value, self.expression(UNARY))
        else:
            left = self.primary()
        while (op := self.operator()) is not None:
            if op in ("=~", "!~"):
                if left[0] not in ("var", "call"):
                    raise ExpressionError("a search needs a name on its left")
                self.take()
                kind, value = self.take()
                if kind != "str":
                    raise ExpressionError("a search needs a string on its right")
                left = ("call", "re_match", [left, ("str", value[1:-1].replace("\\" + value[0], value[0]))])
                if op == "!~":
                    left = ("un", "not", left)
                continue
            strength, right = BINARY[op]
            if strength <= least:
                break
            self.take()
            left = ("bin", op, left, self.expression(right))
        return left

    def primary(self) -> tuple:
        kind, value = self.take()
        if kind == "num":
            if value[:2].lower() == "0x":
                return ("num", int(value, 16))
            return ("num", int(value) if value.isdigit() else float(value))
        if kind == "str":
            return self.method(("str", unescape(value[1:-1])))
        if kind == "tag":
            return ("call", "tag", [("str", value[1:-1])])
        if value == "(":
            node = self.expression(0)
            self.expect(")")
            return self.method(node)
        if kind != "name" or value in ("and", "or", "not"):
            raise ExpressionError(f"unexpected {value or 'end'!r}")
        if value in ("true", "false"):
            return ("bool", value == "true")
        if value == "nil":
            return ("nil",)
        if self.peek()[1] == "(":
            self.take()
            args = []
            if self.peek()[1] != ")":
                args.append(self.argument(value))
                while self.peek()[1] == ",":
                    self.take()
                    args.append(self.expression(0))
            self.expect(")")
            return self.method(("call", value, args))
        if value.startswith("flag.") or value.startswith("flags."):
            bit = value.split(".")[1]
            if bit not in FLAGS:
                raise ExpressionError(f"unknown flag {bit!r}")
            return ("bin", "&", ("var", "flag"), ("num", FLAGS[bit]))
        return self.method(("var", value))

    def argument(self, name: str) -> tuple:
        """In ``exists([XX])`` the tag's name is meant, not its value."""
        if name == "exists" and self.peek()[0] == "tag":
            return ("str", self.take()[1][1:-1])
        return self.expression(0)

    def method(self, node: tuple) -> tuple:
        """``s:upper()`` is ``string.upper(s)``."""
        while self.peek() == ("op", ":"):
            self.take()
            kind, name = self.take()
            if kind != "name":
                raise ExpressionError("a method needs a name")
            self.expect("(")
            args = []
            while self.peek()[1] != ")":
                args.append(self.expression(0))
                if self.peek()[1] == ",":
                    self.take()
            self.expect(")")
            node = ("call", f"string.{name}", [node, *args])
        return node


def parse(source: str) -> tuple:
    if not source.strip():
        raise ExpressionError("empty expression")
    return Parser(source).parse()


def names(node: tuple) -> set[str]:
    """Variables and functions that a tree mentions."""
    if node[0] == "var":
        return {node[1]}
    if node[0] == "call":
        return {node[1]}.union(*(names(a) for a in node[2]))
    return set().union(*(names(a) for a in node[1:] if isinstance(a, tuple)))
