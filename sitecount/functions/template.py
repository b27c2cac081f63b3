"""Row templates: literal text with ``{expression}`` cells, compiled to one concatenation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ExpressionError
from .compiler import Compiler, Scope, text_of
from .language import parse, unescape
from .values import never, opened

_SLOT = re.compile(r"(?<![A-Za-z0-9_.])([acgtnACGTN])\.([0-3])(?![0-9])")


def pieces(template: str) -> list[tuple[str, str]]:
    """("text", literal) and ("cell", expression) in order; ``{{`` is a brace, a lone ``}`` is itself."""
    out, text, at = [], "", 0
    while at < len(template):
        c = template[at]
        if c == "{" and template[at + 1 : at + 2] == "{":
            text, at = text + "{", at + 2
        elif c == "{":
            end = template.find("}", at)
            if end < 0:
                raise ExpressionError("a cell has no end")
            if text:
                out.append(("text", unescape(text)))
            cell = template[at + 1 : end]
            if not cell.strip():
                raise ExpressionError("a cell is empty")
            out.append(("cell", _SLOT.sub(lambda m: m.group(1).lower() + m.group(2), cell)))
            text, at = "", end + 1
        elif c == "\\" and at + 1 < len(template):
            text, at = text + template[at : at + 2], at + 2
        else:
            text, at = text + c, at + 1
    if text:
        out.append(("text", unescape(text)))
    return out


def compile_template(template: str, scope: Scope) -> tuple[Column, Column]:
    """The row's text, and whether it failed. A cell that is nil or false is empty."""
    parts, failed = [], never()
    for kind, body in pieces(template):
        if kind == "text":
            parts.append(F.lit(body))
            continue
        value = opened(Compiler(scope).compile(parse(body)))
        parts.append(value.pick(lambda k, c: F.lit("") if k == "nil" else F.when(c, "true").otherwise("") if k == "bool" else F.coalesce(text_of(k, c), F.lit(""))))
        if value.failed is not None:
            failed = failed | value.fails()
    return F.concat(*parts) if parts else F.lit(""), failed
