"""Values of the expression language as Spark columns.

A value is a list of alternatives (condition, kind, column), of which the first whose condition holds applies, and a condition under which
evaluation has failed. Kinds are static: int, float, str, bool, nil, and tag, a struct of a type letter and three fields, as the type of a tag is
only known for each read. Only nil and false are false. A failed value drops its row, whatever is around it, unless ``and`` or ``or`` skips it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Alternative = tuple[Column | None, str, Column | None]


def never() -> Column:
    return F.lit(False)


def always() -> Column:
    return F.lit(True)


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def either(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a | b


def decide(condition: Column, yes: bool | Column, no: bool | Column) -> bool | Column:
    """``yes`` where the condition holds, else ``no``; known ones shorten it."""
    if isinstance(yes, bool) and isinstance(no, bool):
        return yes if yes == no else condition if yes else ~condition
    if isinstance(yes, bool):
        return condition | no if yes else ~condition & no
    if isinstance(no, bool):
        return ~condition | yes if no else condition & yes
    return F.when(condition, yes).otherwise(no)


@dataclass
class Value:
    """``alternatives`` cover every row: the last one's condition is None."""

    alternatives: list[Alternative]
    failed: Column | None = None

    @classmethod
    def of(cls, kind: str, column: Column | None = None, failed: Column | None = None) -> Value:
        return cls([(None, kind, column)], failed)

    @property
    def kind(self) -> str | None:
        """The kind, where there is only one."""
        kinds = {k for _, k, _ in self.alternatives}
        return kinds.pop() if len(kinds) == 1 else None

    def fails(self) -> Column:
        return never() if self.failed is None else F.coalesce(self.failed, always())

    def pick(self, f: Callable[[str, Column | None], Column]) -> Column:
        """One column from a function of each alternative."""
        *first, (_, kind, column) = self.alternatives
        out = f(kind, column)
        for condition, k, c in reversed(first):
            out = F.when(condition, f(k, c)).otherwise(out)
        return out

    def truthy(self) -> Column:
        out: bool | Column = False
        for condition, k, c in reversed(self.alternatives):
            mine: bool | Column = F.coalesce(c, never()) if k == "bool" else False if k in ("nil", "false") else c.isNotNull() if k == "tag" else True
            out = mine if condition is None else decide(condition, mine, out)
        return F.lit(out) if isinstance(out, bool) else out

    def map(self, f: Callable[[str, Column | None], Value]) -> Value:
        """Apply a function to each alternative; alternatives of one kind are merged."""
        got = [(condition, f(k, c)) for condition, k, c in self.alternatives]
        flat: list[Alternative] = []
        failed = None
        for condition, v in reversed(got):
            inner = v.failed
            if condition is None:
                failed, flat = inner, list(v.alternatives)
            else:
                flat = [(condition if c is None else condition & c, k, x) for c, k, x in v.alternatives] + flat
                if inner is not None or failed is not None:
                    failed = F.when(condition, never() if inner is None else inner).otherwise(never() if failed is None else failed)
        return Value(flat, either(self.failed, failed)).merged()

    def merged(self) -> Value:
        if len({k for _, k, _ in self.alternatives} - {"false"}) == 1 and any(k == "bool" for _, k, _ in self.alternatives):
            self = Value([(c, "bool", never() if k == "false" else x) for c, k, x in self.alternatives], self.failed)
        kinds = {k for _, k, _ in self.alternatives}
        if len(self.alternatives) > 1 and len(kinds) == 1 and kinds != {"nil"}:
            return Value.of(kinds.pop(), self.pick(lambda _, c: c), self.failed)
        return self


def choose(condition: Column, yes: Value, no: Value) -> Value:
    """``yes`` where the condition holds, else ``no``, failures included."""
    alternatives = [(condition if c is None else condition & c, k, x) for c, k, x in yes.alternatives] + no.alternatives
    failed = None
    if yes.failed is not None or no.failed is not None:
        failed = decide(condition, False if yes.failed is None else yes.fails(), False if no.failed is None else no.fails())
    return Value(alternatives, failed).merged()


def connected(x: Value, y: Value, op: str) -> Value:
    """``x and y`` or ``x or y``: the value of an operand, the right one only where it is reached."""
    out: list[Alternative] = []

    def under(condition: Column | None, v: Value) -> list[Alternative]:
        return [(both(condition, c), k, z) for c, k, z in v.alternatives]

    for condition, k, c in x.alternatives:
        if k in ("nil", "false"):
            out += under(condition, y) if op == "or" else [(condition, k, c)]
        elif k == "bool" and op == "and":
            out += [*under(both(condition, F.coalesce(c, never())), y), (condition, "false", None)]
        elif k == "bool":
            out += [(both(condition, F.coalesce(c, never())), "bool", always()), *under(condition, y)]
        elif k == "tag":
            out += [*under(both(condition, c.isNotNull()), y), (condition, "nil", None)] if op == "and" else [(both(condition, c.isNotNull()), k, c), *under(condition, y)]
        else:
            out += under(condition, y) if op == "and" else [(condition, k, c)]
    failed = x.failed
    if y.failed is not None:
        yes = x.truthy()
        failed = either(failed, (yes if op == "and" else ~yes) & y.fails())
    return Value(out, failed).merged()


def tag_alternatives(column: Column) -> Value:
    """A tag's value by its type letter."""
    return Value([(column.isNull(), "nil", None), (column["t"] == "i", "int", column["i"]), (column["t"] == "f", "float", column["f"]), (None, "str", column["s"])])


def opened(value: Value) -> Value:
    """With tags as alternatives of the other kinds, and false as a bool."""
    if all(k not in ("tag", "false") for _, k, _ in value.alternatives):
        return value
    return value.map(lambda k, c: tag_alternatives(c) if k == "tag" else Value.of("bool", never()) if k == "false" else Value.of(k, c))
