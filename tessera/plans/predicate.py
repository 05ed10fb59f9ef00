"""The predicate language: conditions, and boolean expressions over their numbers.

A condition is a string (`field OP value`), a mapping with field, operator and value, or a 3-tuple. An expression such as
`1 AND (2 OR NOT 3) AND kpi < 100` combines conditions by their position, and may hold further conditions in words. One
tree serves both ends: `compile_predicate` makes a Column for Catalyst, `plans.sqltext` makes text with parameters.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "BETWEEN", "NOT BETWEEN", "IN", "NOT IN", "LIKE", "NOT LIKE", "RAW LIKE", "IS", "IS NOT", "IS NULL", "IS NOT NULL", "<=>")
_NAME = r"[A-Za-z_][\w$]*"
_OPERATOR = r"NOT\s+BETWEEN|NOT\s+IN|NOT\s+LIKE|RAW\s+LIKE|IS\s+NOT\s+NULL|IS\s+NULL|IS\s+NOT|BETWEEN|LIKE|IN\b|IS\b|<=>|<=|>=|!=|<>|=|>|<"
_CONDITION = re.compile(rf"^\ufeff?\s*(?P<field>{_NAME})\s*(?P<op>{_OPERATOR})\s*(?P<value>.*)$", re.I | re.S)


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Node:
    """AND, OR, NOT, or (with a condition) a leaf; TRUE is an AND of nothing."""

    kind: str
    children: tuple[Node, ...] = ()
    condition: Condition | None = None
    number: int = 0


TRUE = Node("AND")


# ---------------------------------------------------------------- conditions


def _unquoted(text: str) -> str:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace(text[0] * 2, text[0])
    return text.strip("'\"")


def _listed(text: str) -> list[str]:
    text = text.strip()
    if not (text.startswith("(") and text.endswith(")")):
        raise ValueError(f"IN needs a list in parentheses: {text}")
    inner = text[1:-1].strip()
    return next(csv.reader([inner], quotechar="'", skipinitialspace=True)) if inner else []


def parse_condition(text: str) -> Condition:
    """`field OP value`: IN takes a quoted list, BETWEEN two values joined by AND, quotes around values go."""
    m = _CONDITION.match(text.strip())
    if not m:
        raise ValueError(f"not a condition: {text!r}")
    op = re.sub(r"\s+", " ", m["op"].upper()).replace("<>", "!=")
    raw = m["value"]
    if op in ("IS NULL", "IS NOT NULL"):
        if raw.strip():
            raise ValueError(f"not a condition: {text!r}")
        return Condition(m["field"], op)
    if not raw.strip():
        raise ValueError(f"no value in {text!r}")
    if op in ("IS", "IS NOT"):
        word = raw.strip().upper()
        return Condition(m["field"], op, {"NULL": None, "TRUE": True, "FALSE": False}.get(word, _unquoted(raw)))
    if raw.strip() == "?":
        return Condition(m["field"], op, "?")
    if op.endswith("IN"):
        return Condition(m["field"], op, _listed(raw))
    if op.endswith("BETWEEN"):
        bounds = re.split(r"\band\b", raw, flags=re.I)
        if len(bounds) != 2:
            raise ValueError(f"BETWEEN needs two values: {text!r}")
        return Condition(m["field"], op, tuple(_unquoted(b) for b in bounds))
    return Condition(m["field"], op, _unquoted(raw))


def normalise(condition: Any) -> Condition:
    """Any form of a condition, checked against the operators there are."""
    if isinstance(condition, Condition):
        out = condition
    elif isinstance(condition, str):
        out = parse_condition(condition)
    elif isinstance(condition, Mapping):
        out = Condition(condition["field"], condition["operator"], condition.get("value"))
    elif isinstance(condition, tuple) and len(condition) == 3:
        out = Condition(*condition)
    elif isinstance(condition, tuple):
        raise ValueError("a tuple condition is (field, operator, value)")
    else:
        raise TypeError(f"not a condition: {condition!r}")
    op = re.sub(r"\s+", " ", str(out.operator).strip().upper()).replace("<>", "!=")
    if op not in OPERATORS:
        raise ValueError(f"operator {out.operator!r} is not one of {', '.join(OPERATORS)}")
    value = out.value
    if op.endswith("BETWEEN") and value != "?":
        value = tuple(value) if isinstance(value, (list, tuple)) and len(value) == 2 else (value, value)
    if op.endswith("IN") and value != "?":
        value = list(value) if isinstance(value, (list, tuple, set)) else [value]
    return Condition(out.field.lstrip("\ufeff").strip(), op, value)


def numbered(conditions: Any) -> dict[int, list[Condition]]:
    """Conditions by position from 1; those of a nested list share a number and all hold."""
    if isinstance(conditions, (str, Mapping, tuple, Condition)):
        conditions = [conditions]
    return {k: [normalise(x) for x in (c if isinstance(c, list) else [c])] for k, c in enumerate(conditions or [], 1)}


# ---------------------------------------------------------------- expressions

_TOKEN = re.compile(rf"\s*(?:(?P<paren>[()])|(?P<word>AND|OR|NOT)\b|(?P<number>\d+)\b(?!\s*(?:{_OPERATOR}))|(?P<field>{_NAME})\s*(?P<op>{_OPERATOR}))", re.I)
_VALUE = re.compile(r"\s*('(?:[^']|'')*'|\"[^\"]*\"|[^\s()]+)")


class _Parser:
    def __init__(self, text: str, known: dict[int, list[Condition]]):
        self.text, self.known, self.at = text, known, 0

    def peek(self) -> re.Match | None:
        if not self.text[self.at :].strip():
            return None
        if not (m := _TOKEN.match(self.text, self.at)):
            raise ValueError(f"cannot read {self.text[self.at :].strip()!r} in {self.text!r}")
        return m

    def word(self, *words: str) -> str | None:
        m = self.peek()
        got = (m["word"] or m["paren"] or "").upper() if m else ""
        if got in words:
            self.at = m.end()
            return got
        return None

    def either(self) -> Node:
        out = [self.both()]
        while self.word("OR"):
            out.append(self.both())
        return out[0] if len(out) == 1 else Node("OR", tuple(out))

    def both(self) -> Node:
        out = [self.one()]
        while self.word("AND"):
            out.append(self.one())
        return out[0] if len(out) == 1 else Node("AND", tuple(out))

    def one(self) -> Node:
        if self.word("NOT"):
            return Node("NOT", (self.one(),))
        if self.word("("):
            inner = self.either()
            if not self.word(")"):
                raise ValueError(f"a parenthesis is not closed in {self.text!r}")
            return inner
        m = self.peek()
        if m and m["number"]:
            self.at = m.end()
            k = int(m["number"])
            if k not in self.known:
                raise ValueError(f"there is no condition {k} (there are {len(self.known)})")
            return leaf(k, self.known[k])
        if m and m["field"]:
            return self.inline(m)
        raise ValueError(f"a condition is missing in {self.text!r}")

    def value(self) -> str:
        m = _VALUE.match(self.text, self.at)
        if not m:
            raise ValueError(f"a value is missing in {self.text!r}")
        self.at = m.end()
        return m[1]

    def inline(self, m: re.Match) -> Node:
        start = m.start("field")
        self.at = m.end()
        op = re.sub(r"\s+", " ", m["op"].upper())
        if op.endswith("IN"):
            close = self.text.find(")", self.at)
            if close < 0:
                raise ValueError(f"a list is not closed in {self.text!r}")
            self.at = close + 1
        elif op.endswith("BETWEEN"):
            self.value()
            if not self.word("AND"):
                raise ValueError(f"BETWEEN needs two values in {self.text!r}")
            self.value()
        elif op not in ("IS NULL", "IS NOT NULL"):
            self.value()
        return Node("LEAF", condition=normalise(self.text[start : self.at]))


def leaf(number: int, conditions: list[Condition]) -> Node:
    nodes = tuple(Node("LEAF", condition=c, number=number) for c in conditions)
    return nodes[0] if len(nodes) == 1 else Node("AND", nodes)


def parse_predicate(conditions: Any, expression: str | None = None) -> Node:
    """The tree of conditions combined by an expression; without one, all must hold."""
    known = numbered(conditions)
    if not expression or not expression.strip():
        nodes = tuple(leaf(k, c) for k, c in known.items())
        return nodes[0] if len(nodes) == 1 else Node("AND", nodes)
    parser = _Parser(expression, known)
    out = parser.either()
    if parser.peek():
        raise ValueError(f"cannot read {expression[parser.at :].strip()!r} in {expression!r}")
    return out


# ---------------------------------------------------------------- columns


def resolve(name: str, columns: Iterable[str]) -> str | None:
    """A column's own spelling: the exact name if there is one, else the same without regard to case."""
    columns = list(columns)
    if name in columns:
        return name
    return next((c for c in columns if c.lower() == name.lower()), None)


def literal(value: Any, kind: T.DataType) -> Column:
    """A value as a literal of a column's type; one that is no such value is an error, not a null."""
    if value is None or isinstance(value, Column):
        return F.lit(value)
    if isinstance(kind, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    try:
        if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
            return F.lit({"true": True, "1": True, "false": False, "0": False}[str(value).strip().lower()])
        if isinstance(kind, T.NumericType) and not isinstance(value, bool):
            number = Decimal(str(value).strip())
            if isinstance(kind, T.IntegralType):
                return F.lit(int(number)) if number == int(number) else F.lit(float(number))
            return F.lit(float(number)) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.lit(number)
        if isinstance(kind, T.DateType):
            return F.lit(value if isinstance(value, date) else datetime.fromisoformat(str(value).strip()).date())
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).strip())
            return F.lit(at.isoformat(sep=" ")).cast(kind)
    except (ValueError, KeyError, InvalidOperation) as e:
        raise ValueError(f"{value!r} is not a value of type {kind.simpleString()}") from e
    return F.lit(value)


def _compare(c: Column, op: str, value: Any, of: Callable[[Any], Column]) -> Column:
    match op:
        case "=":
            return c == of(value)
        case "!=":
            return c != of(value)
        case ">":
            return c > of(value)
        case ">=":
            return c >= of(value)
        case "<":
            return c < of(value)
        case "<=":
            return c <= of(value)
        case "<=>":
            return c.eqNullSafe(of(value))
        case "BETWEEN" | "NOT BETWEEN":
            low, high = value if isinstance(value, tuple) else (value, value)
            inside = c.between(of(low), of(high))
            return inside if op == "BETWEEN" else ~inside
        case "IN" | "NOT IN":
            inside = c.isin([of(v) for v in value]) if isinstance(value, list) and value else F.lit(False) if isinstance(value, list) else c == of(value)
            return inside if op == "IN" else ~inside
        case "LIKE" | "NOT LIKE":
            holds = c.cast("string").contains(of(value).cast("string"))
            return holds if op == "LIKE" else ~holds
        case "RAW LIKE":
            return c.cast("string").like(str(value))
        case "IS NULL":
            return c.isNull()
        case "IS NOT NULL":
            return c.isNotNull()
        case "IS":
            return c.eqNullSafe(of(value))
        case "IS NOT":
            return ~c.eqNullSafe(of(value))
    raise ValueError(f"operator {op!r}")


def compile_predicate(node: Node, schema: T.StructType, source: Callable[[str], Column | None] | None = None, target: Callable[[str], Column] = F.col, allow_missing: bool = False) -> Column:
    """A predicate as a Column over `schema`.

    source: gives the column that a `?` stands for by the condition's field, or None: the condition is then passed over
    (it holds). A field that the schema lacks is an error, or with allow_missing passed over.
    """

    def walk(n: Node) -> Column:
        if n.kind == "LEAF":
            return one(n.condition)
        if n.kind == "NOT":
            return ~walk(n.children[0])
        out = None
        for child in n.children:
            c = walk(child)
            out = c if out is None else out & c if n.kind == "AND" else out | c
        return F.lit(True) if out is None else out

    def one(c: Condition) -> Column:
        name = resolve(c.field, schema.fieldNames())
        asked = isinstance(c.value, str) and c.value == "?"
        given = source(c.field) if asked and source else None
        if name is None:
            if allow_missing or asked:
                return F.lit(True)
            raise ValueError(f"there is no column {c.field!r}; there are {', '.join(schema.fieldNames())}")
        if asked and given is None:
            return F.lit(True)
        kind = schema[name].dataType
        return _compare(target(name), c.operator, given if asked else c.value, lambda v: v if isinstance(v, Column) else literal(v, kind))

    return walk(node)


def where(df: DataFrame, conditions: Any, expression: str | None = None, allow_missing: bool = False) -> DataFrame:
    """The rows for which the predicate holds; built-in expressions only, so that it reaches the scan."""
    return df.where(compile_predicate(parse_predicate(conditions, expression), df.schema, target=lambda n: df[f"`{n}`"], allow_missing=allow_missing))


def select(df: DataFrame, columns: list[str] | None = None, conditions: Any = None, expression: str | None = None) -> DataFrame:
    """SELECT columns (in any case, spelled as the table does; None: all) WHERE the predicate holds."""
    out = where(df, conditions, expression) if conditions or expression else df
    if columns is None:
        return out
    names = [resolve(c, df.columns) for c in columns]
    if None in names:
        raise ValueError(f"there is no column {', '.join(c for c, n in zip(columns, names, strict=True) if n is None)}")
    return out.select(*[f"`{n}`" for n in names])
