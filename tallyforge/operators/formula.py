"""Formula strings compiled to Spark columns.

`y ~ a*b + C(g, Sum) + x/z + (a + b + c)**2 + I(x ** 2) - 1`: terms are sets of factors; + adds, - removes, : interacts,
* crosses, / nests, ** takes all interactions up to an order. There is an intercept unless -1 or 0 stands outside
parentheses. String columns are categorical of themselves. A categorical factor is coded in full or without one column,
as keeps the columns of the whole model independent.
"""

from __future__ import annotations

import ast
import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

CODINGS = ("Treatment", "Sum", "Helmert", "Diff", "Poly")
Term = tuple[str, ...]


@dataclass
class Design:
    response: Column | None
    names: list[str]
    columns: list[Column]
    levels: dict[str, list] = field(default_factory=dict)

    def frame(self, df: DataFrame, *more: Column) -> DataFrame:
        """y, x0, x1, ... as doubles; rows with a null or NaN in any of them are left out."""
        cells = [] if self.response is None else [self.response.cast("double").alias("y")]
        cells += [c.cast("double").alias(f"x{i}") for i, c in enumerate(self.columns)]
        return df.select(*cells, *more).na.drop("any")


class Parser:
    """Recursive descent over the right-hand side of a formula; terms keep the order in which they appear."""

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def sums(self, inner: bool) -> tuple[list[Term], bool]:
        terms, intercept, sign = [], True, "+"
        if self.peek() in ("+", "-"):
            sign = self.take()
        while True:
            word = self.peek()
            if word in ("0", "1") and (self.at + 1 == len(self.tokens) or self.tokens[self.at + 1] in ("+", "-", ")")):
                self.take()
                intercept = (word == "1") == (sign == "+")
            else:
                for term in self.products():
                    same = [t for t in terms if set(t) == set(term)]
                    if sign == "+" and not same:
                        terms.append(term)
                    elif sign == "-":
                        terms = [t for t in terms if t not in same]
            if self.peek() not in ("+", "-"):
                break
            sign = self.take()
        return terms, intercept

    def products(self) -> list[Term]:
        left = self.interactions()
        while self.peek() in ("*", "/"):
            sign, right = self.take(), self.interactions()
            whole = [tuple(dict.fromkeys(itertools.chain(*left)))]
            left = unique(left + (right + crossed(left, right) if sign == "*" else crossed(whole, right)))
        return left

    def interactions(self) -> list[Term]:
        left = self.powers()
        while self.peek() == ":":
            self.take()
            left = unique(crossed(left, self.powers()))
        return left

    def powers(self) -> list[Term]:
        base = self.atom()
        while self.peek() == "**":
            self.take()
            n = self.take() if self.peek() else ""
            if not n.isdigit() or int(n) < 1:
                raise ValueError("** needs a whole number from 1")
            out = base
            for _ in range(min(int(n), len(base)) - 1):
                out = unique(out + crossed(out, base))
            base = out
        return base

    def atom(self) -> list[Term]:
        word = self.peek()
        if word is None or word in ("+", "-", "*", "/", ":", "**", ")", "~"):
            raise ValueError(f"a term is missing before {word or 'the end'}")
        self.take()
        if word == "(":
            terms, _ = self.sums(True)
            if self.peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            self.take()
            return terms
        if word in ("0", "1"):
            return [()] if word == "1" else []
        return [(word,)]


def tokens(text: str) -> list[str]:
    """Operators, numbers, names, and calls with all that stands in their parentheses."""
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        if text.startswith("**", i):
            out.append("**")
            i += 2
        elif text[i] in "+-*/:()~":
            out.append(text[i])
            i += 1
        else:
            m = re.compile(r"`[^`]+`|[\w.]+").match(text, i)
            if not m:
                raise ValueError(f"{text[i]!r} can't stand in a formula")
            j = m.end()
            if j < len(text) and text[j] == "(":
                depth = 0
                while j < len(text):
                    depth += (text[j] == "(") - (text[j] == ")")
                    j += 1
                    if not depth:
                        break
                if depth:
                    raise ValueError("a parenthesis isn't closed")
            out.append(text[i:j])
            i = j
    return out


def crossed(left: list[Term], right: list[Term]) -> list[Term]:
    return [tuple(dict.fromkeys(a + b)) for a in left for b in right]


def unique(terms: list[Term]) -> list[Term]:
    out: dict[frozenset, Term] = {}
    for t in terms:
        out.setdefault(frozenset(t), t)
    return list(out.values())


def parse(formula: str) -> tuple[str | None, list[Term], bool]:
    """Response (None without ~), terms other than the intercept, and whether there is one."""
    left, tilde, right = formula.partition("~")
    response, body = (left.strip() or None, right) if tilde else (None, formula)
    if tilde and not response:
        raise ValueError("the response is missing")
    if not body.strip():
        raise ValueError("the terms are missing")
    parser = Parser(body)
    terms, intercept = parser.sums(False)
    if parser.peek() is not None:
        raise ValueError(f"{parser.peek()!r} is one too many")
    return response, [t for t in terms if t], intercept


def contrast(coding: str, levels: list[str], full: bool) -> tuple[list[str], np.ndarray]:
    """Suffixes and matrix (level by column) of a coding; full adds the column that a reduced one leaves out."""
    n = len(levels)
    if coding == "Treatment":
        eye = np.eye(n)
        return ([f"[{v}]" for v in levels], eye) if full else ([f"[T.{v}]" for v in levels[1:]], eye[:, 1:])
    if coding == "Sum":
        m, names, lead = np.vstack([np.eye(n - 1), -np.ones((1, n - 1))]), [f"[S.{v}]" for v in levels[:-1]], "[mean]"
    elif coding == "Helmert":
        m = np.array([[-1.0 if i <= j else float(j + 1) if i == j + 1 else 0.0 for j in range(n - 1)] for i in range(n)]).reshape(n, n - 1)
        names, lead = [f"[H.{v}]" for v in levels[1:]], "[H.intercept]"
    elif coding == "Diff":
        m = np.array([[(j + 1 - n) / n if i <= j else (j + 1) / n for j in range(n - 1)] for i in range(n)]).reshape(n, n - 1)
        names, lead = [f"[D.{v}]" for v in levels[:-1]], f"[D.{levels[-1]}]"
        if full:
            return [f"[D.{v}]" for v in levels], np.column_stack([np.ones(n), m])
    elif coding == "Poly":
        q, r = np.linalg.qr(np.vander(np.arange(n) - (n - 1) / 2, n, increasing=True))
        m = (q * np.sign(np.diag(r)))[:, 1:]
        names, lead = [{1: ".Linear", 2: ".Quadratic", 3: ".Cubic"}.get(k, f"^{k}") for k in range(1, n)], ".Constant"
    else:
        raise ValueError(f"{coding} isn't one of {', '.join(CODINGS)}")
    return ([lead, *names], np.column_stack([np.ones(n), m])) if full else (names, m)


def pick_codings(categorical: Term, used: set[frozenset]) -> list[dict[str, bool]]:
    """Codings (factor to full or reduced) that add to the columns of used what the term adds, and no more.

    A term stands for all subsets of its factors in reduced coding. Those not in used yet are joined pair by
    pair: a subset and the same with one more reduced factor are the latter with that factor in full.
    """
    subsets = [s for k in range(len(categorical) + 1) for s in itertools.combinations(categorical, k) if frozenset(s) not in used]
    used.update(map(frozenset, subsets))
    parts = [{f: False for f in s} for s in subsets]
    again = True
    while again:
        again = False
        for i, j in itertools.combinations(range(len(parts)), 2):
            short, long = parts[i], parts[j]
            more = [f for f in long if f not in short]
            if len(more) == 1 and not long[more[0]] and len(long) == len(short) + 1 and all(long[f] == short[f] for f in short):
                parts[j] = {f: short.get(f, True) for f in long}
                del parts[i]
                again = True
                break
    return parts


_CALLS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "log1p": F.log1p, "expm1": F.expm1, "log10": F.log10, "log2": F.log2, "I": lambda x: x, "power": F.pow}


def arithmetic(text: str) -> Column:
    """+ - * / ** and functions of columns and numbers. Division by zero gives null, so that the row is left out."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            if isinstance(node.op, ast.Div):
                return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Pow: lambda: F.pow(a, b)}[type(node.op)]()
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return F.col(f"`{node.id}`")
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            if name in _CALLS:
                return _CALLS[name](*map(build, node.args))
        raise ValueError

    try:
        return build(ast.parse(text, mode="eval"))
    except (ValueError, SyntaxError, KeyError):
        return F.expr(text)


def category(df: DataFrame, factor: str) -> tuple[str, str] | None:
    """Column and coding of a categorical factor; None for a numeric one."""
    call = re.fullmatch(r"C\(\s*(`[^`]+`|[^,]+?)\s*(?:,\s*(\w+)\s*(?:\(\s*\))?\s*)?\)", factor)
    if call:
        coding = call.group(2) or "Treatment"
        if coding not in CODINGS:
            raise ValueError(f"{coding} isn't one of {', '.join(CODINGS)}")
        return call.group(1), coding
    bare = factor.strip("`")
    if bare in df.columns and isinstance(df.schema[bare].dataType, (StringType, BooleanType)):
        return factor, "Treatment"
    return None


def design(df: DataFrame, formula: str) -> Design:
    """Columns of a formula over df. Levels of all categories come from one distinct pass each, in order.

    Terms are grouped by their numeric factors, those without first, then by their order; in an interaction the
    left factor's columns change fastest. As many columns as a factor has levels: there is no bound but the
    driver's memory.
    """
    response, terms, intercept = parse(formula)
    factors = list(dict.fromkeys(itertools.chain(*terms)))
    kinds = {f: category(df, f) for f in factors}
    levels: dict[str, list] = {}
    for f, kind in kinds.items():
        if kind:
            x = F.expr(kind[0])
            levels[f] = sorted(r[0] for r in df.select(x.alias("v")).where("v is not null").distinct().collect())
    numeric = lambda t: tuple(f for f in t if not kinds[f])
    buckets: dict[frozenset, list[Term]] = {frozenset(): [()] if intercept else []}
    for t in terms:
        buckets.setdefault(frozenset(numeric(t)), []).append(t)
    names, columns = [], []
    for bucket in buckets.values():
        used: set[frozenset] = set()
        for term in sorted(bucket, key=len):
            for coding in pick_codings(tuple(f for f in term if kinds[f]), used):
                parts = []
                for f in term:
                    if not kinds[f]:
                        parts.append([(f, arithmetic(f))])
                    elif f in coding:
                        text, matrix = contrast(kinds[f][1], [str(v) for v in levels[f]], coding[f])
                        x = F.expr(kinds[f][0])
                        cells = []
                        for j, suffix in enumerate(text):
                            cell = F.when(x == F.lit(levels[f][0]), float(matrix[0, j]))
                            for i, v in enumerate(levels[f][1:], 1):
                                if matrix[i, j]:
                                    cell = cell.when(x == F.lit(v), float(matrix[i, j]))
                            cells.append((f + suffix, cell.when(x.isNotNull(), 0.0)))
                        parts.append(cells)
                for combination in itertools.product(*reversed(parts)):
                    chosen = combination[::-1]
                    names.append(":".join(n for n, _ in chosen) if chosen else "Intercept")
                    column = F.lit(1.0)
                    for k, (_, c) in enumerate(chosen):
                        column = c if k == 0 else column * c
                    columns.append(column)
    return Design(None if response is None else arithmetic(response), names, columns, levels)
