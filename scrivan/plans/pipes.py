"""A small piped query language compiled to DataFrame plans.

``FROM t | WHERE … | EVAL x = … | STATS n = COUNT(*), s = SUM(x) BY k | SORT k DESC | KEEP a, b | DROP c | RENAME a AS b |
LIMIT 10``. Words of the language may be written in either case. Conditions know ``== != < <= > >=``, ``AND OR NOT``,
``LIKE``, ``RLIKE``, ``IN``, ``IS [NOT] NULL`` and arithmetic; functions are COUNT, COUNT_DISTINCT, SUM, AVG, MIN, MAX,
MEDIAN, PERCENTILE, ROUND, LENGTH, LOWER, UPPER, YEAR, CONCAT, COALESCE. Everything is parsed; nothing of a query is
handed to an SQL parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([A-Za-z_][\w.]*)|(==|!=|<=|>=|[-+*/%(),=<>|]))")
_AGGREGATES = {"COUNT", "COUNT_DISTINCT", "SUM", "AVG", "MIN", "MAX", "MEDIAN", "PERCENTILE"}


class SyntaxFault(ValueError):
    """A query that the language doesn't know."""


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected {text[at:at + 10]!r}")
        number, double, single, word, sign = m.groups()
        if number is not None:
            out.append(("number", number))
        elif double is not None or single is not None:
            out.append(("string", re.sub(r"\\(.)", r"\1", double if double is not None else single)))
        elif word is not None:
            out.append(("word", word))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") and self.tokens[self.at][1].upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxFault(f"expected {' or '.join(words)}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise SyntaxFault("expected a name")

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def integer(self) -> int:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            self.at += 1
            return int(self.tokens[self.at - 1][1])
        raise SyntaxFault("expected a number")

    # conditions and values, by binding strength
    def either(self) -> Column:
        out = self.both()
        while self.take("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.take("AND"):
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        return ~self.negated() if self.take("NOT") else self.compared()

    def compared(self) -> Column:
        left = self.sum()
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return left.isNotNull() if no else left.isNull()
        no = self.take("NOT")
        if self.take("IN"):
            self.need("(")
            values = [self.sum()]
            while self.take(","):
                values.append(self.sum())
            self.need(")")
            out = left.isin(*values)
            return ~out if no else out
        for word, test in (("LIKE", self._like), ("RLIKE", lambda c, p: F.regexp_like(c, F.lit(p)))):
            if self.take(word):
                kind, pattern = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "string":
                    raise SyntaxFault("expected a pattern")
                self.at += 1
                out = test(left, pattern)
                return ~out if no else out
        for sign, test in (("==", Column.__eq__), ("!=", Column.__ne__), ("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if self.take(sign):
                return test(left, self.sum())
        return left

    @staticmethod
    def _like(col: Column, pattern: str) -> Column:
        return F.regexp_like(col, F.lit("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"))

    def sum(self) -> Column:
        out = self.product()
        while self.peek("+", "-"):
            plus = self.take("+") or not self.take("-")
            out = out + self.product() if plus else out - self.product()
        return out

    def product(self) -> Column:
        out = self.atom()
        while self.peek("*", "/", "%"):
            if self.take("*"):
                out = out * self.atom()
            elif self.take("/"):
                out = out / self.atom()
            else:
                self.need("%")
                out = out % self.atom()
        return out

    def atom(self) -> Column:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.take("-"):
            return -self.atom()
        if self.at >= len(self.tokens):
            raise SyntaxFault("the query ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text) if "." in text else int(text))
        if kind == "string":
            return F.lit(text)
        if kind != "word":
            raise SyntaxFault(f"unexpected {text!r}")
        if text.upper() in ("TRUE", "FALSE", "NULL"):
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[text.upper()])
        if self.take("("):
            return self.call(text.upper())
        return F.col(f"`{text}`")

    def call(self, name: str) -> Column:
        if name == "COUNT" and self.take("*"):
            self.need(")")
            return F.count(F.lit(1))
        args = [] if self.peek(")") else [self.either()]
        while self.take(","):
            args.append(self.either())
        self.need(")")
        known: dict[str, Callable[..., Column]] = {
            "COUNT": lambda *a: F.count(a[0] if a else F.lit(1)), "COUNT_DISTINCT": F.countDistinct, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "MEDIAN": F.median,
            "PERCENTILE": lambda c, p: F.percentile(c, p / 100), "ROUND": F.round, "LENGTH": F.length, "LOWER": F.lower, "UPPER": F.upper, "YEAR": F.year, "CONCAT": F.concat, "COALESCE": F.coalesce,
        }
        if name not in known:
            raise SyntaxFault(f"no function {name}")
        return known[name](*args)

    def assigned(self) -> tuple[str | None, Column, str]:
        start = self.at
        if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at + 1] == ("sign", "="):
            name = self.name()
            self.need("=")
        else:
            name = None
        at = self.at
        col = self.either()
        return name, col, "".join(t for _, t in self.tokens[at if name is None else start : self.at])


def compiled(query: str, table: Callable[[str], DataFrame]) -> DataFrame:
    """The DataFrame of a piped query; ``table`` gives a table by name."""
    p = _Parser(lex(query))
    p.need("FROM")
    df = table(p.name())
    while p.take("|"):
        if p.take("WHERE"):
            df = df.where(p.either())
        elif p.take("EVAL"):
            while True:
                name, col, text = p.assigned()
                df = df.withColumn(name or text, col)
                if not p.take(","):
                    break
        elif p.take("STATS"):
            aggs = []
            while True:
                name, col, text = p.assigned()
                aggs.append(col.alias(name or text))
                if not p.take(","):
                    break
            df = df.groupBy(*[F.col(f"`{k}`") for k in (p.names() if p.take("BY") else [])]).agg(*aggs)
        elif p.take("SORT"):
            order = []
            while True:
                c = F.col(f"`{p.name()}`")
                down = p.take("DESC") or (p.take("ASC") and False)
                nulls = None
                if p.take("NULLS"):
                    nulls = "first" if p.take("FIRST") else (p.need("LAST"), "last")[1]
                order.append({(True, None): c.desc_nulls_first, (False, None): c.asc_nulls_last, (True, "first"): c.desc_nulls_first, (True, "last"): c.desc_nulls_last, (False, "first"): c.asc_nulls_first, (False, "last"): c.asc_nulls_last}[bool(down), nulls]())
                if not p.take(","):
                    break
            df = df.orderBy(*order)
        elif p.take("LIMIT"):
            df = df.limit(p.integer())
        elif p.take("KEEP"):
            df = df.select(*[F.col(f"`{c}`") for c in p.names()])
        elif p.take("DROP"):
            df = df.drop(*p.names())
        elif p.take("RENAME"):
            while True:
                old = p.name()
                p.need("AS")
                df = df.withColumnRenamed(old, p.name())
                if not p.take(","):
                    break
        else:
            raise SyntaxFault("expected a command after |")
    if p.at != len(p.tokens):
        raise SyntaxFault(f"unexpected {p.tokens[p.at][1]!r}")
    return df
