"""Metric expressions: arithmetic and comparisons over named metrics, compiled to Spark columns.

    comparison     additive (("<" | "<=" | ">" | ">=" | "==" | "!=") additive)*
    additive       product (("+" | "-") product)*
    product        unary (("*" | "/") unary)*
    unary          ("+" | "-") unary | primary
    primary        number | name | "(" comparison ")" | min(a, b) | max(a, b) | abs(a)

Comparisons go from left to right and give 1.0 or 0.0. A compiled expression is a
pair of columns: the value, and the first error in order of evaluation (left before
right) or null. Nothing raises at run time: division by zero and overflow are errors
of a row, under a policy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_.:]*)|(?P<op><=|>=|==|!=|[-+*/()<>,]))")
_ARITY = {"min": 2, "max": 2, "abs": 1}
_COMPARISONS = ("<", "<=", ">", ">=", "==", "!=")

#: Aliases of report counters (fixed values): each may be written with or without the prefix `report.`.
REPORT = ("total_trades", "net_profit", "input_bars_processed", "script_bars_processed", "magnifier_sample_ticks_total")


class ExpressionError(ValueError):
    def __init__(self, what: str, offset: int):
        super().__init__(f"{what} at {offset}")
        self.offset = offset


@dataclass(frozen=True)
class Policy:
    """reject: a row's error; otherwise IEEE-754 results pass."""

    reject_division_by_zero: bool = True
    reject_non_finite: bool = True


@dataclass
class Expression:
    text: str
    tree: tuple = ()
    identifiers: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._tokens = self._lex()
        self._at = 0
        if self._kind() == "end":
            raise ExpressionError("empty expression", 0)
        self.tree = self._comparison()
        if self._kind() != "end":
            raise ExpressionError(f"unexpected {self._value()!r}", self._offset())

    # ---- reading

    def _lex(self):
        out, at = [], 0
        end = len(self.text.rstrip())
        while at < end:
            m = _TOKEN.match(self.text, at)
            if not m:
                raise ExpressionError("unknown character", at + len(self.text[at:]) - len(self.text[at:].lstrip()))
            kind = m.lastgroup
            if kind == "number" and abs(float(m[kind])) == float("inf"):
                raise ExpressionError("number out of range", m.start(kind))
            out.append((kind, m[kind], m.start(kind)))
            at = m.end()
        return [*out, ("end", "", end)]

    def _kind(self):
        return self._tokens[self._at][0]

    def _value(self):
        return self._tokens[self._at][1]

    def _offset(self):
        return self._tokens[self._at][2]

    def _take(self, *ops):
        if self._kind() == "op" and self._value() in ops:
            self._at += 1
            return self._tokens[self._at - 1][1]
        return None

    def _need(self, op):
        if not self._take(op):
            raise ExpressionError(f"expected {op!r}", self._offset())

    def _left(self, below, ops):
        node = below()
        while op := self._take(*ops):
            node = (op, node, below())
        return node

    def _comparison(self):
        return self._left(self._additive, _COMPARISONS)

    def _additive(self):
        return self._left(self._product, ("+", "-"))

    def _product(self):
        return self._left(self._unary, ("*", "/"))

    def _unary(self):
        if op := self._take("+", "-"):
            return ("neg", self._unary()) if op == "-" else self._unary()
        return self._primary()

    def _primary(self):
        kind, value, offset = self._tokens[self._at]
        if kind == "number":
            self._at += 1
            return ("number", float(value))
        if kind == "name":
            self._at += 1
            if self._kind() == "op" and self._value() == "(":
                if value not in _ARITY:
                    raise ExpressionError(f"unknown function {value!r}", offset)
                self._at += 1
                args = [self._comparison()]
                while self._take(","):
                    args.append(self._comparison())
                self._need(")")
                if len(args) != _ARITY[value]:
                    raise ExpressionError(f"{value} takes {_ARITY[value]} arguments", offset)
                return (value, *args)
            if value not in self.identifiers:
                self.identifiers.append(value)
            return ("name", value)
        if self._take("("):
            node = self._comparison()
            self._need(")")
            return node
        raise ExpressionError("expected a value", offset)

    # ---- compiling

    def compile(self, metric, policy: Policy = Policy()) -> tuple[Column, Column]:
        """(value, error). metric: name -> (column, or None if there's no such metric)."""
        return self._compile(self.tree, metric, policy)

    def _compile(self, node, metric, policy):
        none = F.lit(None).cast("string")
        op = node[0]
        if op == "number":
            return F.lit(node[1]), none
        if op == "name":
            c = metric(node[1])
            if c is None:
                return F.lit(None).cast("double"), F.lit("missing_metric")
            c = c.cast("double")
            bad = _odd(c)
            error = F.when(c.isNull(), F.lit("missing_metric"))
            return c, error.when(bad, F.lit("non_finite_metric")) if policy.reject_non_finite else error
        parts = [self._compile(n, metric, policy) for n in node[1:]]
        values, errors = [v for v, _ in parts], [e for _, e in parts]
        a, b = values[0], values[-1]
        error = F.coalesce(*errors)
        if op == "/":
            zero = b == 0.0
            ieee = F.when(F.isnan(a) | F.isnan(b) | (a == 0.0), F.lit(float("nan"))).when((a > 0) == ~_negative_zero(b), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            value = F.when(zero, ieee).otherwise(F.try_divide(a, b))
            if policy.reject_division_by_zero:
                error = F.coalesce(error, F.when(zero, F.lit("division_by_zero")))
        elif op in _COMPARISONS:
            # Spark holds NaN equal to itself and above all numbers; here it's unequal to everything
            nan = F.isnan(a) | F.isnan(b)
            plain = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
            value = F.when(nan, F.lit(1.0 if op == "!=" else 0.0)).when(plain, F.lit(1.0)).otherwise(F.lit(0.0))
        elif op in ("min", "max"):
            value = F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b) if op == "min" else F.greatest(a, b))
        else:
            value = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "neg": lambda: -a, "abs": lambda: F.abs(a)}[op]()
        if policy.reject_non_finite and op not in _COMPARISONS:
            error = F.coalesce(error, F.when(_odd(value), F.lit("non_finite_result")))
        return F.when(error.isNull(), value), error


def _odd(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def _negative_zero(c: Column) -> Column:
    return c.cast("string") == "-0.0"


def columns(df_columns: list[str]):
    """A metric lookup over plain columns, in which report counters go by both of their names."""
    known = set(df_columns)

    def metric(name: str):
        bare = name.removeprefix("report.")
        for n in (name, bare if bare in REPORT else name, f"report.{name}"):
            if n in known:
                return F.col(f"`{n}`")
        return None

    return metric


def satisfied(value: Column, error: Column) -> Column:
    """A constraint holds if its value isn't zero; null where it couldn't be computed."""
    return F.when(error.isNull(), value != 0.0)


def violation(lhs: Column, relation: str, rhs: float, tolerance: float = 0.0) -> Column:
    """How far a structured constraint lhs <= / >= / == rhs is from being met; infinite if lhs isn't finite."""
    gap = {"<=": lhs - rhs, ">=": F.lit(rhs) - lhs, "==": F.abs(lhs - rhs)}[relation]
    return F.when(lhs.isNull() | _odd(lhs), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), gap - tolerance))


def status(objective: tuple[Column, Column], constraints: list[tuple[Column, Column]]) -> Column:
    """Terminal status of a row: objective first, then the constraints in order."""
    out = F.when(objective[1].isNotNull(), F.lit("objective_error"))
    for value, error in constraints:
        out = out.when(error.isNotNull(), F.lit("constraint_error")).when(value == 0.0, F.lit("constraint_violation"))
    return out.otherwise(F.lit("ok"))


def feasible(objective: tuple[Column, Column], constraints: list[tuple[Column, Column]]) -> Column:
    """Whether a trial's objective has a value and all of its constraints do and hold."""
    out = objective[1].isNull()
    for value, error in constraints:
        out = out & F.coalesce(satisfied(value, error), F.lit(False))
    return out
