"""Searching: substring and phrase search, keyword search, field conditions and a Lucene-like query language."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.scalars import path

from .timeseries import floored


def by_id(df: DataFrame, q: str, *columns: str) -> DataFrame:
    """Rows where a column contains the text; LIKE's wildcards mean themselves."""
    return df.where(reduce(Column.__or__, (F.coalesce(F.col(c).contains(q), F.lit(False)) for c in columns)))


def terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def match_any(c: Column | str, text: str) -> Column:
    found = terms(text)
    return F.arrays_overlap(tokens(c), F.array(*map(F.lit, found))) if found else F.lit(False)


def match_all(c: Column | str, text: str) -> Column:
    found = terms(text)
    return reduce(Column.__and__, (F.array_contains(tokens(c), t) for t in found)) if found else F.lit(False)


def match_phrase(c: Column | str, text: str, prefix: bool = False) -> Column:
    """The terms side by side and in order; with ``prefix`` the last one may go on."""
    found = terms(text)
    if not found:
        return F.lit(False)
    end = "" if prefix else r"(?![\p{L}\p{N}])"
    return F.rlike(F.lower(c), F.lit(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(found) + end))


def keyword(q: str, text_columns: list[str], number_columns: list[str] = ()) -> Column:
    """A quoted text is a phrase and a number is equality as well; any of the columns may match."""
    quoted = len(q) > 1 and q[0] == q[-1] == '"'
    parts = [match_phrase(c, q) if quoted else match_any(c, q) for c in text_columns]
    if re.fullmatch(r"-?\d+(\.\d+)?", q):
        parts += [F.col(c) == F.lit(float(q)) for c in number_columns]
    return reduce(Column.__or__, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(False))


def field(name: str, columns: dict[str, str]) -> Column:
    """A column, or a dotted path into a JSON column."""
    head, *rest = name.split(".")
    if head not in columns:
        raise KeyError(name)
    return path(columns[head], *rest) if rest else F.col(columns[head])


def field_condition(c: Column, op: str, value=None) -> Column:
    """A field filter by its operator's name."""
    table = {
        "=": lambda: c == value, "!=": lambda: c != value, "like": lambda: c.contains(value), "not like": lambda: ~c.contains(value),
        "match_any": lambda: match_any(c, value), "match_all": lambda: match_all(c, value), "match_phrase": lambda: match_phrase(c, value), "match_phrase_prefix": lambda: match_phrase(c, value, True),
        "is null": lambda: c.isNull(), "is not null": lambda: c.isNotNull(), "between": lambda: c.between(*value), "not between": lambda: ~c.between(*value), "in": lambda: c.isin(list(value)), "not in": lambda: ~c.isin(list(value)),
    }
    return table[op]()


@dataclass
class _Token:
    kind: str
    text: str


_LEX = re.compile(r"""\s+|(?P<open>\()|(?P<close>\))|(?P<and>&&|AND\b)|(?P<or>\|\||OR\b)|(?P<not>NOT\b|!)|(?P<minus>-(?=\S))|(?P<field>[\w.]+):|(?P<range>[\[{]\s*(?P<low>\S+)\s+TO\s+(?P<high>[^\s\]}]+)\s*[\]}])|(?P<compare>>=|<=|>|<)|"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<word>[^\s()":]+)""")


def _lex(q: str) -> list[_Token]:
    out, at = [], 0
    while at < len(q):
        m = _LEX.match(q, at)
        if not m:
            raise ValueError(f"cannot read {q[at:]!r}")
        at = m.end()
        kind = next((k for k in ("open", "close", "and", "or", "not", "minus", "field", "range", "compare", "quoted", "word") if m[k] is not None), None)
        if kind:
            out.append(_Token(kind, f"{m['low']}\0{m['high']}" if kind == "range" else m[kind]))
    return out


class Lucene:
    """Recursive descent over: or := and (OR and)*, and := not ((AND)? not)*, not := (NOT | -)* term, term := ( or ) | [field:] value.

    ``columns`` maps fields to columns, ``text`` lists those that are searched by words. Unknown fields match nothing."""

    def __init__(self, columns: dict[str, str], text: list[str]):
        self.columns, self.text = columns, text

    def parse(self, q: str) -> Column:
        self.tokens, self.at = _lex(q), 0
        if not self.tokens:
            return F.lit(True)
        out = self._or()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at].text!r}")
        return out

    def _peek(self) -> str:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else ""

    def _next(self) -> _Token:
        if self.at >= len(self.tokens):
            raise ValueError("the query ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def _or(self) -> Column:
        out = self._and()
        while self._peek() == "or":
            self._next()
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._not()
        while self._peek() not in ("", "close", "or"):
            if self._peek() == "and":
                self._next()
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self._peek() in ("not", "minus"):
            self._next()
            return ~self._not()
        if self._peek() == "open":
            self._next()
            out = self._or()
            if self._next().kind != "close":
                raise ValueError("a bracket is not closed")
            return out
        return F.coalesce(self._term(), F.lit(False))

    def _term(self) -> Column:
        t = self._next()
        if t.kind == "field":
            try:
                c = field(t.text, self.columns)
            except KeyError:
                self._next()
                return F.lit(False)
            return self._value(c, t.text in self.text)
        if t.kind == "quoted":
            return reduce(Column.__or__, (F.coalesce(match_phrase(self.columns[n], t.text), F.lit(False)) for n in self.text))
        if t.kind == "word":
            one = (lambda c: match_phrase(c, t.text[:-1], True)) if t.text.endswith("*") else (lambda c: match_any(c, t.text))
            return reduce(Column.__or__, (F.coalesce(one(self.columns[n]), F.lit(False)) for n in self.text))
        raise ValueError(f"unexpected {t.text!r}")

    def _value(self, c: Column, is_text: bool) -> Column:
        t = self._next()
        if t.kind == "range":
            low, high = (F.lit(x) if not re.fullmatch(r"-?\d+(\.\d+)?", x) else F.lit(float(x)) for x in t.text.split("\0"))
            return c.between(low, high)
        if t.kind == "compare":
            v = self._next().text
            v = F.lit(float(v)) if re.fullmatch(r"-?\d+(\.\d+)?", v) else F.lit(v)
            return {">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v}[t.text]
        if t.kind == "minus":
            v = self._next().text
            return c == F.lit("-" + v)
        if t.kind == "quoted":
            return match_phrase(c, t.text) if is_text else c == t.text
        if t.kind != "word":
            raise ValueError(f"unexpected {t.text!r}")
        if t.text == "*":
            return c.isNotNull() & (c.cast("string") != "")
        if t.text.startswith("*") and t.text.endswith("*"):
            return c.contains(t.text[1:-1])
        if t.text.startswith("*"):
            return c.endswith(t.text[1:])
        if t.text.endswith("*"):
            return c.startswith(t.text[:-1])
        return match_any(c, t.text) if is_text else c == F.lit(t.text)


def chart(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """Hits by bucket of a number of seconds."""
    return df.groupBy(floored(time, seconds).alias("time_dimension")).agg(F.count(F.lit(1)).alias("count"))


def per_tenant_views(df: DataFrame, column: str, tenant: str, name: str) -> None:
    """A temporary view of one tenant's rows: ad-hoc SQL sees nothing else, and no SQL text is rewritten."""
    df.where(F.col(column) == tenant).createOrReplaceTempView(name)
