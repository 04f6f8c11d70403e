"""Formulas as a typed expression graph.

A formula is text in the usual notation, ``-1 * correlation(rank(open), rank(volume), 10)``. It is parsed, never executed: only
arithmetic, comparisons, field names, parameters and registered operators are accepted. ``x = ...; y = ...; x / y`` names
parts of a formula. Equal subexpressions are one node.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Collection
from dataclasses import dataclass
from functools import lru_cache

FIELDS = ("open", "high", "low", "close", "volume", "returns")
ROW, TIME, CROSS = "row", "time", "cross"
#: Operators by axis: (number of series, number of trailing numbers).
SIGNATURES = {
    "add": (ROW, 2, 0), "sub": (ROW, 2, 0), "mul": (ROW, 2, 0), "div": (ROW, 2, 0), "neg": (ROW, 1, 0),
    "lt": (ROW, 2, 0), "gt": (ROW, 2, 0), "le": (ROW, 2, 0), "ge": (ROW, 2, 0), "where": (ROW, 3, 0), "emin": (ROW, 2, 0), "emax": (ROW, 2, 0),
    "power": (ROW, 2, 0), "signedpower": (ROW, 2, 0), "log": (ROW, 1, 0), "sign": (ROW, 1, 0), "abs": (ROW, 1, 0), "sqrt": (ROW, 1, 0), "log1p": (ROW, 1, 0),
    "expm1": (ROW, 1, 0), "tanh": (ROW, 1, 0), "fill": (ROW, 1, 1), "clip": (ROW, 1, 2), "isfinite": (ROW, 1, 0), "rowmax": (ROW, 3, 0), "safediv": (ROW, 2, 0), "only": (ROW, 2, 0), "pick": (ROW, 3, 0), "before": (ROW, 0, 1),
    "delay": (TIME, 1, 1), "delta": (TIME, 1, 1), "lead": (TIME, 1, 1), "ts_sum": (TIME, 1, 1), "ts_mean": (TIME, 1, 1), "stddev": (TIME, 1, 1), "ts_min": (TIME, 1, 1),
    "ts_max": (TIME, 1, 1), "ts_rank": (TIME, 1, 1), "ts_argmax": (TIME, 1, 1), "ts_argmin": (TIME, 1, 1), "correlation": (TIME, 2, 1), "covariance": (TIME, 2, 1),
    "decay_linear": (TIME, 1, 1), "product": (TIME, 1, 1), "stddev_pop": (TIME, 1, 1), "ts_median": (TIME, 1, 1), "ts_var": (TIME, 1, 1), "ts_count": (TIME, 1, 1),
    "mean_min": (TIME, 1, 2), "std_min": (TIME, 1, 2), "sum_min": (TIME, 1, 2), "max_min": (TIME, 1, 2), "var_min": (TIME, 1, 2), "median_min": (TIME, 1, 2), "stdp_min": (TIME, 1, 2), "pct_change": (TIME, 1, 1), "ewm": (TIME, 1, 1), "ewm_rec": (TIME, 1, 1), "cumprod": (TIME, 1, 0), "cummax": (TIME, 1, 0), "cumcount": (TIME, 1, 0),
    "rank": (CROSS, 1, 0), "avgrank": (CROSS, 1, 0), "rank_centered": (CROSS, 1, 1), "midrank": (CROSS, 1, 0), "scale": (CROSS, 1, 1), "demean": (CROSS, 1, 0), "zscore": (CROSS, 1, 0),
    "zscore_eps": (CROSS, 1, 1), "zscore_zero": (CROSS, 1, 1), "zscore_fill": (CROSS, 1, 0), "zscore_pop": (CROSS, 1, 2), "xmean": (CROSS, 1, 1), "xcount": (CROSS, 1, 0), "xstd": (CROSS, 1, 0), "least_names": (CROSS, 1, 1), "unit": (CROSS, 1, 0), "market_sum": (CROSS, 1, 1),
}
#: Trailing numbers that may be left out.
DEFAULTS = {"scale": (1.0,), "rank_centered": (2,), "xmean": (1,), "fill": (0.0,), "pct_change": (1,), "zscore_eps": (1e-8,), "zscore_zero": (1e-12,), "zscore_pop": (2, 1e-12)}
_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Pow: "power"}
_COMPARE = {ast.Lt: "lt", ast.Gt: "gt", ast.LtE: "le", ast.GtE: "ge"}


@dataclass(frozen=True)
class Node:
    """``op`` is 'field', 'const' or an operator; ``numbers`` are window lengths and the like, already whole where they must be."""

    op: str
    args: tuple["Node", ...] = ()
    numbers: tuple[float, ...] = ()
    name: str = ""

    @property
    def axis(self) -> str:
        return SIGNATURES[self.op][0] if self.op in SIGNATURES else ROW


def field(name: str) -> Node:
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}")
    return Node("field", name=name)


def fields_of(n: Node) -> list[str]:
    """The fields that a formula reads, in the panel's order."""
    found, todo = set(), [n]
    while todo:
        at = todo.pop()
        found |= {at.name} if at.op == "field" else set()
        todo += at.args
    return [f for f in FIELDS if f in found]


def const(value: float) -> Node:
    return Node("const", numbers=(float(value),))


def call(op: str, *args: Node, numbers: tuple[float, ...] = ()) -> Node:
    axis, series, trailing = SIGNATURES[op]
    if len(args) != series:
        raise ValueError(f"{op} takes {series} series, not {len(args)}")
    if len(numbers) < trailing:
        numbers = numbers + DEFAULTS.get(op, ())[len(numbers) - trailing :]
    if len(numbers) != trailing:
        raise ValueError(f"{op} takes {trailing} numbers")
    if (axis == TIME or op == "market_sum") and numbers:
        numbers = tuple(math.floor(x) for x in numbers)  # lengths are floored: 8.9 days are 8
        if numbers[0] < 1:
            raise ValueError(f"{op}: a window needs a day")
        if len(numbers) > 1 and numbers[1] > numbers[0]:
            raise ValueError(f"{op}: min_periods {numbers[1]} must be <= window {numbers[0]}")
    return Node(op, tuple(args), tuple(numbers))


def parse(text: str, adv_dollar: bool = False, **params: float) -> Node:
    """A formula's graph. Parameters are names for numbers; ``adv(d)`` is the mean volume, or mean dollar volume."""
    return _parse(text, adv_dollar, tuple(sorted(params.items())))


@lru_cache(maxsize=4096)
def _parse(text: str, adv_dollar: bool, params: tuple[tuple[str, float], ...]) -> Node:
    known, parts = dict(params), {}

    def number(n: ast.expr) -> float | None:
        node = walk(n)
        return node.numbers[0] if node.op == "const" else None

    def walk(n: ast.expr) -> Node:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return const(n.value)
        if isinstance(n, ast.Name):
            return parts[n.id] if n.id in parts else const(known[n.id]) if n.id in known else field(n.id)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            inner = walk(n.operand)
            return const(-inner.numbers[0]) if inner.op == "const" else call("neg", inner)
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            a, b = walk(n.left), walk(n.right)
            if a.op == b.op == "const":
                x, y = a.numbers[0], b.numbers[0]
                if y == 0 and isinstance(n.op, ast.Div):
                    return call("div", a, b)  # 0 / 0 is the missing value
                return const({"add": x + y, "sub": x - y, "mul": x * y, "div": x / y if y else 0.0, "power": x**y}[_BINARY[type(n.op)]])
            return call(_BINARY[type(n.op)], a, b)
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _COMPARE:
            return call(_COMPARE[type(n.ops[0])], walk(n.left), walk(n.comparators[0]))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            if n.func.id == "adv":
                volume = field("volume")
                return call("ts_mean", call("mul", field("close"), volume) if adv_dollar else volume, numbers=(number(n.args[0]),))
            if n.func.id not in SIGNATURES:
                raise ValueError(f"unknown operator {n.func.id!r}")
            series = SIGNATURES[n.func.id][1]
            numbers = tuple(number(a) for a in n.args[series:])
            if None in numbers:
                raise ValueError(f"{n.func.id}: lengths must be numbers")
            return call(n.func.id, *(walk(a) for a in n.args[:series]), numbers=numbers)
        raise ValueError(f"not a formula: {ast.unparse(n)}")

    *named, last = ast.parse(" ".join(text.split())).body
    for n in named:
        if not (isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name)):
            raise ValueError(f"not a part of a formula: {ast.unparse(n)}")
        parts[n.targets[0].id] = walk(n.value)
    if not isinstance(last, ast.Expr):
        raise ValueError(f"not a formula: {ast.unparse(last)}")
    return walk(last.value)


@dataclass(frozen=True)
class Step:
    """Nodes that one pass computes: a stage is one partitioning (time: by symbol, cross: by date); depth orders within it."""

    stage: int
    depth: int
    axis: str
    nodes: tuple[Node, ...]


def schedule(roots: list[Node], known: Collection[Node] = ()) -> list[Step]:
    """All window nodes below the roots, in passes. Even stages are along time, odd ones across symbols. ``known`` nodes have a column already."""
    seen: dict[Node, tuple[int, int]] = {n: (0, -1) for n in known}

    def visit(n: Node) -> tuple[int, int]:
        if n in seen:
            return seen[n]
        stage, depth = max((visit(a) for a in n.args), default=(0, -1))
        if n.axis != ROW:
            own = stage + (stage % 2 != (n.axis == CROSS))
            stage, depth = own, depth + 1 if own == stage else 0
        seen[n] = (stage, depth)
        return seen[n]

    for r in roots:
        visit(r)
    passes: dict[tuple[int, int], list[Node]] = {}
    for n, at in seen.items():
        if n.axis != ROW and n not in known:
            passes.setdefault(at, []).append(n)
    return [Step(s, d, TIME if s % 2 == 0 else CROSS, tuple(passes[s, d])) for s, d in sorted(passes)]
