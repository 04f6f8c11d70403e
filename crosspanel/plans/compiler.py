"""From formula graphs to a Spark plan: one pass of window columns for each stage and depth, many formulas in one plan."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from ..operators.history import AROUND, BLOCK, ewm_frame, numbered, with_surroundings
from ..operators.history import ROW as ROW_NUMBER
from ..operators.series import ACROSS, ALONG_TIME, DATE, ROWWISE, SHORT, SYMBOL, along, along_names, market_sum, short_rank
from ..operators.sliding import SLIDING, slide
from ..sources.panel import PRICES, densify
from .expr import CROSS, ROW, TIME, Node, Step, call, schedule


def _column(n: Node, names: dict[Node, str]) -> Column:
    if n in names:
        return F.col(names[n])
    if n.op == "field":
        return F.col(n.name)
    if n.op == "const":
        return F.lit(n.numbers[0])
    return ROWWISE[n.op](*(_column(a, names) for a in n.args), *n.numbers)


#: Operators that need a symbol's whole past; their rows aren't cut into blocks.
_ENDLESS = frozenset(("ewm", "ewm_rec", "cumprod", "cummax", "cumcount"))
_SHIFTS = frozenset(("delay", "delta", "pct_change", "lead"))


def reach(n: Node, inside: frozenset[Node]) -> tuple[int, int]:
    """Rows before and after a row that the node needs, through the nodes of ``inside`` that it is made of."""
    back, ahead = (max((reach(a, inside)[i] for a in n.args), default=0) for i in (0, 1))
    if n not in inside:
        return back, ahead
    own = int(n.numbers[0]) if n.numbers else 0
    if n.op == "lead":
        return back, ahead + own
    extra = 1 if n.op == "correlation" and own == 2 else 0  # looks at the change from the row before its window's last
    return back + (own if n.op in _SHIFTS else own - 1 + extra), ahead


def _time_step(df: DataFrame, nodes: tuple[Node, ...], names: dict[Node, str], fresh: dict[Node, str]) -> DataFrame:
    """One pass along time: window columns together, then sliding order statistics in one grouped pass, then exponential means.

    Ranks in short windows are window columns too: rows don't leave Spark for them, and aren't sorted again when they come back.
    """
    short = {n for n in fresh if n.op == "ts_rank" and n.numbers[0] <= SHORT}
    plain = {n: name for n, name in fresh.items() if n.op in ALONG_TIME or n in short}
    df = df.withColumns({name: (short_rank if n in short else ALONG_TIME[n.op])(*(_column(a, names) for a in n.args), *n.numbers) for n, name in plain.items()})
    sliding = {n: name for n, name in fresh.items() if n.op in SLIDING and n not in short}
    if sliding:
        inputs = {n: f"{name}_in" for n, name in sliding.items()}
        df = df.withColumns({inputs[n]: _column(n.args[0], names).cast("double") for n in sliding})
        df = slide(df, list(along_names()), DATE, [(name, inputs[n], n.op, tuple(map(int, n.numbers))) for n, name in sliding.items()]).drop(*inputs.values())
    for n, name in fresh.items():
        if n.op in ("ewm", "ewm_rec"):
            df = ewm_frame(df, finite(_column(n.args[0], names)), n.numbers[0], n.op == "ewm_rec", name)
    return df


def evaluate(panel: DataFrame, formulas: dict[str, Node], keep: tuple[str, ...] = (), block_rows: int | None = None) -> DataFrame:
    """``date, symbol, *keep`` and a column for each formula.

    Stages alternate between partitioning by symbol and by date; each costs one exchange, however many formulas there are.
    Row-wise results that several windows need are computed once, in the pass before.

    ``block_rows``: a symbol's rows are cut into blocks of so many (or as many as windows reach), each with the rows around it that
    its windows need, so that one symbol's long history is the work of many tasks. Results are the same. Cumulative and exponential
    operators carry a state through the whole history; stages that have them are not cut.
    """
    names: dict[Node, str] = {}
    df, extra = panel, ()
    roots = list(formulas.values())
    steps = schedule(roots)
    if block_rows is not None and any(s.axis == TIME for s in steps):
        df, extra = numbered(panel), (ROW_NUMBER,)
    df = _stages(df, steps, roots, names, keep, extra, block_rows or 1)
    return _final(df, formulas, names, keep)


def _stages(df: DataFrame, steps: list[Step], roots: list[Node], names: dict[Node, str], keep: tuple[str, ...], extra: tuple[str, ...] = (), block_rows: int = 1) -> DataFrame:
    """All passes of ``steps``. Rows with a number (``extra``) are cut into blocks where a stage along time can be."""
    for stage in sorted({s.stage for s in steps}):
        mine = [s for s in steps if s.stage == stage]
        inside = frozenset(n for s in mine for n in s.nodes)
        cut = bool(extra) and mine[0].axis == TIME and not any(n.op in _ENDLESS for n in inside)
        if cut:
            back, ahead = (max(reach(n, inside)[i] for n in inside) for i in (0, 1))
            df = with_surroundings(df, max(block_rows, back, ahead), back, ahead)
        with along(SYMBOL, BLOCK) if cut else along(SYMBOL):
            for step in mine:
                df = _step(df, step, names)
                live = _live(roots, names)  # columns that nothing needs any more would be resolved again in every later pass
                marks = [c for c in (*extra, *((BLOCK, AROUND) if cut else ())) if c not in keep]
                df = df.select(DATE, SYMBOL, *keep, *marks, *sorted({n.name for n in live if n.op == "field"} - set(keep)), *(names[n] for n in sorted(live, key=lambda n: names.get(n, "")) if n in names))
        if cut:
            df = df.filter(~F.col(AROUND)).drop(BLOCK, AROUND)
    return df


def _final(df: DataFrame, formulas: dict[str, Node], names: dict[Node, str], keep: tuple[str, ...]) -> DataFrame:
    df = _rows(df, list(formulas.values()), names)
    return df.select(DATE, SYMBOL, *keep, *(_column(n, names).cast("double").alias(name) for name, n in formulas.items()))


#: Row-wise operators that are NULL where any argument is, and operators across symbols that skip NULL and give NULL for it.
_STRICT = frozenset(("add", "sub", "mul", "div", "neg", "lt", "gt", "le", "ge", "emin", "emax", "power", "signedpower", "log", "sign", "abs", "sqrt", "log1p", "expm1", "tanh", "clip", "isfinite", "safediv"))
_SKIPPING = frozenset(("rank", "avgrank", "rank_centered", "midrank", "scale", "demean", "zscore", "zscore_eps", "zscore_zero", "zscore_pop", "least_names", "unit"))


def _below(roots: list[Node], end: frozenset[Node] = frozenset()) -> set[Node]:
    """All nodes of the graphs, down to those in ``end``, which are the last."""
    found, todo = set(), list(roots)
    while todo:
        if (n := todo.pop()) not in found:
            found.add(n)
            todo += () if n in end else n.args
    return found


def _flat(roots: list[Node]) -> frozenset[Node]:
    """Nodes across symbols that filled rows can't change: made of one date's prices alone, NULL on rows without prices."""

    @cache
    def plain(n: Node) -> bool:
        return (n.axis == ROW or flat(n)) and all(map(plain, n.args))

    @cache
    def missing(n: Node) -> bool:
        return n.op == "field" or (any(map(missing, n.args)) if n.op in _STRICT else flat(n))

    @cache
    def flat(n: Node) -> bool:
        return n.op in _SKIPPING and all(map(plain, n.args)) and all(map(missing, n.args))

    return frozenset(filter(flat, _below(roots)))


def rank_products(formulas: dict[str, Node]) -> tuple[dict[str, Node], dict[str, tuple[str, ...]]]:
    """Formulas that are products of ranks of one date's prices, for a step that has a date's rows together: it can rank them itself.

    Gives the other formulas with the series that are ranked, and for each such formula the names of the series whose ranks, over
    a date's observed rows, are multiplied from left to right.
    """
    series: dict[Node, str] = {}
    others, products = {}, {}

    def factors(n: Node) -> list[Node] | None:
        if n.op == "mul":
            left, right = map(factors, n.args)
            return left + right if left and right and len(right) == 1 else None
        single = n.op == "rank" and n in _flat([n]) and all(a.axis == ROW for a in _below(list(n.args)))
        return list(n.args) if single else None

    for name, n in formulas.items():
        if found := factors(n):
            products[name] = tuple(series.setdefault(x, f"_x{len(series)}") for x in found)
        else:
            others[name] = n
    return others | {name: x for x, name in series.items()}, products


def evaluate_observed(panel: DataFrame, formulas: dict[str, Node], keep: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """``evaluate`` on the panel with its gaps filled, observed rows only: ``date, symbol, *keep`` and a column for each formula.

    Rows are filled only for what needs them. Cross-sections of one date's prices are taken before if windows along time need them,
    and else last, on observed rows, so that neither they nor filled rows travel with the others. With ``by`` rows go by this column
    before the last row-wise parts are computed: what these are made of travels, and the next step finds its rows together.
    """
    roots = list(formulas.values())
    flat = _flat(roots)
    upper = _below(roots, flat)  # without what only flat nodes are made of
    others = [n for n in upper if n.axis != ROW and n not in flat]
    names: dict[Node, str] = {}
    fields = (*PRICES, "returns")
    carried = tuple(c for c in keep if c not in fields)
    if not others:
        df = panel.filter(F.col(SYMBOL).isNotNull())
    else:
        df = panel
        early = sorted((n for n in _below(others, flat) if n in flat), key=repr)
        if early:
            df = df.withColumns({c: F.when(F.col(SYMBOL).isNotNull(), F.col(c)) for c in fields})  # those without a symbol have no rank
            df = _stages(df, schedule(early), early, first := {}, (*fields, *carried))
            names = {n: f"_e{i}" for i, n in enumerate(early)}
            df = df.select(DATE, SYMBOL, *fields, *carried, *(F.col(first[n]).alias(name) for n, name in names.items()))
        df = densify(df, (*names.values(), *carried))
        df = _stages(df, schedule(roots, flat), roots, names, (*keep, "observed")).filter("observed")
    df = _stages(df, schedule([n for n in upper if n in flat], frozenset(names)), roots, names, keep)
    return _final(df.repartition(by) if by else df, formulas, names, keep)


def _leaf(n: Node) -> bool:
    return n.op in ("field", "const")


def _rows(df: DataFrame, roots: list[Node], names: dict[Node, str]) -> DataFrame:
    """Adds a column for each row-wise node below the roots, level by level: an expression that repeats its arguments, as guarded
    ones do, then repeats a name, and a plan grows with its formulas and not with a power of their depth."""
    depth: dict[Node, int] = {}

    def visit(n: Node) -> int:
        if n in names or _leaf(n) or n.axis != ROW:
            return 0
        if n not in depth:
            depth[n] = 1 + max((visit(a) for a in n.args), default=0)
        return depth[n]

    for r in roots:
        visit(r)
    for level in range(1, max(depth.values(), default=0) + 1):
        mine = sorted((n for n, d in depth.items() if d == level), key=repr)
        fresh = {n: f"_r{len(names) + i}" for i, n in enumerate(mine)}
        df = df.withColumns({name: _column(n, names) for n, name in fresh.items()})
        names |= fresh
    return df


def _live(roots: list[Node], names: dict[Node, str]) -> set[Node]:
    """Nodes and fields that have a column and that something still to be computed needs."""
    found, todo = set(), list(roots)
    while todo:
        n = todo.pop()
        if n in found:
            continue
        if n in names or n.op == "field":
            found.add(n)
        else:
            todo += n.args
    return found


def _step(df: DataFrame, step: Step, names: dict[Node, str]) -> DataFrame:
    """Adds the columns of one pass, and their names to ``names``."""
    df = _rows(df, [a for n in step.nodes for a in n.args if a.axis == ROW], names)
    fresh = {n: f"_w{len(names) + i}" for i, n in enumerate(step.nodes)}
    if step.axis == TIME:
        df = _time_step(df, step.nodes, names, fresh)
    else:
        for n, name in fresh.items():
            if n.op == "market_sum":
                df = market_sum(df, _column(n.args[0], names), n.numbers[0], name)
        df = df.withColumns({name: ACROSS[n.op](*(_column(a, names) for a in n.args), *n.numbers) for n, name in fresh.items() if n.op != "market_sum"})
    names |= fresh
    return df


def neutral(n: Node, min_names: int = 20, neutralize: bool = True) -> Node:
    """A signal's final form: infinities and thin dates dropped, demeaned, at unit gross exposure."""
    n = call("isfinite", n)
    if min_names:
        n = call("least_names", n, numbers=(min_names,))
    return call("unit", call("demean", n)) if neutralize else n
