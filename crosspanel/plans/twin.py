"""The same formula graphs in DuckDB SQL, from the definitions: a second opinion on every operator."""

from __future__ import annotations

from .expr import ROW, TIME, Node, schedule


def _fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'inf'::DOUBLE WHEN {a} < 0 THEN '-inf'::DOUBLE END WHEN isinf({a}) AND isinf({b}) THEN NULL ELSE {a} / {b} END)"


def _guard(expr: str, *args: str) -> str:
    """An arithmetic result, NULL where infinities cancel."""
    return f"(CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END)"


_ROWWISE = {
    "add": lambda a, b: _guard(f"({a} + {b})"),
    "sub": lambda a, b: _guard(f"({a} - {b})"),
    "mul": lambda a, b: _guard(f"({a} * {b})"),
    "div": _div,
    "neg": lambda a: f"(-({a}))",
    "lt": lambda a, b: f"(({a}) < ({b}))::INT::DOUBLE",
    "gt": lambda a, b: f"(({a}) > ({b}))::INT::DOUBLE",
    "le": lambda a, b: f"(({a}) <= ({b}))::INT::DOUBLE",
    "ge": lambda a, b: f"(({a}) >= ({b}))::INT::DOUBLE",
    "where": lambda c, a, b: f"(CASE WHEN ({c}) IS NULL THEN NULL WHEN ({c}) > 0.5 THEN {a} ELSE {b} END)",
    "emin": lambda a, b: f"(CASE WHEN {a} <= {b} THEN {a} WHEN {b} < {a} THEN {b} END)",
    "emax": lambda a, b: f"(CASE WHEN {a} >= {b} THEN {a} WHEN {b} > {a} THEN {b} END)",
    "power": lambda x, y: f"(sign({x}) * pow(abs({x}), {y}))",
    "signedpower": lambda x, y: f"(sign({x}) * pow(abs({x}), {y}))",
    "log": lambda x: f"(CASE WHEN {x} > 0 THEN ln({x}) END)",
    "sign": lambda x: f"sign({x})::DOUBLE",
    "abs": lambda x: f"abs({x})",
    "sqrt": lambda x: f"(CASE WHEN {x} >= 0 THEN sqrt({x}) END)",
    "log1p": lambda x: f"(CASE WHEN {x} > -1 THEN ln(1 + {x}) END)",
    "expm1": lambda x: f"(exp({x}) - 1)",
    "tanh": lambda x: f"tanh({x})",
    "fill": lambda x, v: f"coalesce({x}, {v}::DOUBLE)",
    "clip": lambda x, low, high: f"(CASE WHEN {x} < {low} THEN {low}::DOUBLE WHEN {x} > {high} THEN {high}::DOUBLE ELSE {x} END)",
    "isfinite": _fin,
    "rowmax": lambda a, b, c: f"greatest({a}, {b}, {c})",
    "before": lambda days: f"(date < DATE '1970-01-01' + {int(days)})::INT::DOUBLE",
    "only": lambda c, x: f"(CASE WHEN {c} > 0.5 THEN {x} END)",
    "pick": lambda c, a, b: f"(CASE WHEN {c} > 0.5 THEN {a} ELSE {b} END)",
    "safediv": lambda a, b: f"(CASE WHEN abs({b}) > 1e-15 THEN {a} / {b} END)",
}


def _over(d: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


_T = "OVER (PARTITION BY symbol ORDER BY date)"
_D = "OVER (PARTITION BY date)"


def _roll(name: str):
    def sql(x: str, d: int, least: int | None = None) -> str:
        return f"(CASE WHEN count({_fin(x)}) {_over(d)} >= {d if least is None else least} THEN {name}({_fin(x)}) {_over(d)} END)"

    return sql


def _pair(x: str, y: str) -> tuple[str, str]:
    both = f"isfinite({x}) AND isfinite({y})"
    return f"(CASE WHEN {both} THEN {x} END)", f"(CASE WHEN {both} THEN {y} END)"


def _corr(x: str, y: str, d: int) -> str:
    a, b = _pair(x, y)
    w = _over(d)
    if d == 2:
        turn = [f"(CASE WHEN abs({v} - lag({v}) {_T}) > greatest(abs({v}), abs(lag({v}) {_T})) * 1e-12 THEN sign({v} - lag({v}) {_T}) END)" for v in (a, b)]
        return f"({turn[0]} * {turn[1]})::DOUBLE"
    return f"(CASE WHEN count({a}) {w} >= {d} THEN round(covar_samp({a}, {b}) {w} / nullif(stddev_samp({a}) {w} * stddev_samp({b}) {w}, 0) * 1e12) / 1e12 END)"


def _cov(x: str, y: str, d: int) -> str:
    a, b = _pair(x, y)
    w = _over(d)
    spread = f"nullif(stddev_samp({a}) {w} * stddev_samp({b}) {w}, 0)"
    unit = f"coalesce(pow(2.0, floor(log2({spread}))), 1)"
    return f"(CASE WHEN count({a}) {w} >= {d} THEN round(covar_samp({a}, {b}) {w} / {unit} * 1e12) / 1e12 * {unit} END)"


def _ts_rank(x: str, d: int) -> str:
    rows = f"(list({_fin(x)}) {_over(d)})"
    below = f"len(list_filter({rows}, lambda e: e < {x}))"
    level = f"len(list_filter({rows}, lambda e: e = {x}))"
    return f"(CASE WHEN count({_fin(x)}) {_over(d)} >= {d} THEN ({below} + ({level} + 1) / 2.0) / {d} END)"


def _arg(f: str):
    return lambda x, d: f"(CASE WHEN count({x}) {_over(d)} >= {d} THEN list_position(list({x}) {_over(d)}, list_{f}(list({x}) {_over(d)}))::DOUBLE END)"


def _decay(x: str, d: int) -> str:
    terms = " + ".join(f"{d - k} * lag({x}, {k}) {_T}" for k in range(d))
    return _guard(f"(({terms}) / {d * (d + 1) / 2})")


def _ewm(x: str, span: int) -> str:
    keep = 1 - 2 / (span + 1)
    w = _over(40 * (span + 1))
    rows = f"(list(CASE WHEN isfinite({x}) THEN {{'i': rn, 'v': {x}}} END) {w})"
    some = f"list_filter({rows}, lambda e: e IS NOT NULL)"
    return f"(list_sum(list_transform({some}, lambda e: e.v * pow({keep!r}, rn - e.i))) / list_sum(list_transform({some}, lambda e: pow({keep!r}, rn - e.i))))"


def _ewm_rec(x: str, span: int) -> str:
    keep = 1 - 2 / (span + 1)
    rows = f"list_filter(list(CASE WHEN isfinite({x}) THEN {{'i': rn, 'v': {x}}} END) {_over(40 * (span + 1))}, lambda e: e IS NOT NULL)"
    step = f"{{'i': e.i, 'v': (s.v * pow({keep!r}, e.i - s.i) + e.v * {1 - keep!r}) / (pow({keep!r}, e.i - s.i) + {1 - keep!r})}}"
    return f"(CASE WHEN len({rows}) > 0 THEN list_reduce({rows}, lambda s, e: {step}).v END)"


def _avgrank(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0 END)"


def _n(x: str) -> str:
    return f"count({x}) {_D}"


def _z(x: str, spread: str) -> str:
    return f"(({x} - avg({x}) {_D}) / {spread})"


_ALONG = {
    "delay": lambda x, d: f"lag({x}, {d}) {_T}",
    "lead": lambda x, d: f"lead({x}, {d}) {_T}",
    "delta": lambda x, d: _guard(f"({x} - lag({x}, {d}) {_T})"),
    "pct_change": lambda x, d: f"({_div(x, f'lag({x}, {d}) {_T}')} - 1)",
    "ts_sum": _roll("sum"), "ts_mean": _roll("avg"), "stddev": _roll("stddev_samp"), "stddev_pop": _roll("stddev_pop"), "ts_var": _roll("var_samp"),
    "ts_min": _roll("min"), "ts_max": _roll("max"), "ts_median": _roll("median"), "product": _roll("product"),
    "mean_min": _roll("avg"), "std_min": _roll("stddev_samp"), "stdp_min": _roll("stddev_pop"), "var_min": _roll("var_samp"), "sum_min": _roll("sum"), "max_min": _roll("max"), "median_min": _roll("median"),
    "ts_count": lambda x, d: f"(count({_fin(x)}) {_over(d)})::DOUBLE",
    "ts_rank": _ts_rank, "ts_argmax": _arg("max"), "ts_argmin": _arg("min"), "correlation": _corr, "covariance": _cov, "decay_linear": _decay, "ewm": _ewm, "ewm_rec": _ewm_rec,
    "cumprod": lambda x: f"product({x}) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "cumcount": lambda x: f"(count({_fin(x)}) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))::DOUBLE",
    "cummax": lambda x: f"max({x}) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)",
}
_ACROSS = {
    "rank": lambda x: f"({_avgrank(x)} / {_n(x)})",
    "avgrank": _avgrank,
    "rank_centered": lambda x, least: f"(CASE WHEN {_n(x)} >= {least} THEN 2 * ({_avgrank(x)} - 1) / nullif({_n(x)} - 1, 0) - 1 END)",
    "midrank": lambda x: f"(({_avgrank(x)} - 0.5) / {_n(x)})",
    "scale": lambda x, a: f"({a} * {x} / nullif(sum(abs({x})) {_D}, 0))",
    "demean": lambda x: _guard(f"({x} - avg({x}) {_D})"),
    "zscore": lambda x: _z(x, f"nullif(stddev_samp({x}) {_D}, 0)"),
    "zscore_eps": lambda x, eps: _z(x, f"(stddev_samp({x}) {_D} + {eps})"),
    "zscore_zero": lambda x, eps: f"(CASE WHEN {x} IS NULL THEN NULL WHEN {_n(x)} >= 2 AND stddev_samp({x}) {_D} > {eps} THEN {_z(x, f'(stddev_samp({x}) {_D})')} ELSE 0 END)",
    "zscore_fill": lambda x: f"coalesce({_z(x, f'nullif(stddev_samp({x}) {_D}, 0)')}, 0)",
    "zscore_pop": lambda x, least, eps: f"(CASE WHEN {_n(x)} >= {least} AND stddev_pop({x}) {_D} > {eps} THEN {_z(x, f'(stddev_pop({x}) {_D})')} END)",
    "xmean": lambda x, least: f"(CASE WHEN {_n(x)} >= {least} THEN avg({x}) {_D} END)",
    "xcount": lambda x: f"({_n(x)})::DOUBLE",
    "xstd": lambda x: f"stddev_samp({x}) {_D}",
    "least_names": lambda x, least: f"(CASE WHEN {_n(x)} >= {least} THEN {x} END)",
    "unit": lambda x: f"({x} / nullif(sum(abs({x})) {_D}, 0))",
}
#: Operators with a twin; ``market_sum`` is a step of its own.
SQL_OPS = {**_ROWWISE, **_ALONG, **_ACROSS}


def _sql(n: Node, names: dict[Node, str]) -> str:
    if n in names:
        return names[n]
    if n.op == "field":
        return n.name
    if n.op == "const":
        return f"{n.numbers[0]!r}::DOUBLE"
    return _ROWWISE[n.op](*(_sql(a, names) for a in n.args), *n.numbers)


def evaluate_sql(panel: str, formulas: dict[str, Node], keep: tuple[str, ...] = (), prelude: str = "", digits: int | None = 6) -> str:
    """SQL for ``date, symbol, *keep`` and the formulas, over the relation ``panel`` that the CTEs in ``prelude`` define.

    Every window node and every row-wise input of one is a column of its own step, so no expression is repeated."""
    names: dict[Node, str] = {}
    steps = [f"s0 AS (SELECT *, row_number() {_T} AS rn FROM {panel})"]
    last = "s0"

    def add(columns: dict[Node, str]) -> None:
        nonlocal last
        if columns:
            fresh = {n: f"c{len(names) + i}" for i, n in enumerate(columns)}
            steps.append(f"s{len(steps)} AS (SELECT *, {', '.join(f'{sql} AS {fresh[n]}' for n, sql in columns.items())} FROM {last})")
            last = f"s{len(steps) - 1}"
            names.update(fresh)

    def rows(n: Node) -> None:
        """Row-wise nodes below and at n, innermost first."""
        if n in names or n.op in ("field", "const") or n.axis != ROW:
            return
        for a in n.args:
            rows(a)
        add({n: _sql(n, names)})

    for step in schedule(list(formulas.values())):
        for n in step.nodes:
            for a in n.args:
                rows(a)
        table = _ALONG if step.axis == TIME else _ACROSS
        for n in step.nodes:
            if n.op == "market_sum":
                v, d = _sql(n.args[0], names), n.numbers[0]
                frame = f"OVER (ORDER BY date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
                daily = f"SELECT date, CASE WHEN count(v) {frame} >= {d} THEN sum(v) {frame} END AS v FROM (SELECT date, max({_fin(v)}) AS v FROM {last} GROUP BY date)"
                steps.append(f"s{len(steps)} AS (SELECT p.*, m.v AS c{len(names)} FROM {last} p JOIN ({daily}) m USING (date))")
                last = f"s{len(steps) - 1}"
                names[n] = f"c{len(names)}"
        add({n: table[n.op](*(_sql(a, names) for a in n.args), *n.numbers) for n in step.nodes if n.op != "market_sum"})
    for n in formulas.values():
        rows(n)
    out = ", ".join(["date", "symbol", *keep, *(f"{f'round({_sql(n, names)}, {digits})' if digits is not None else _sql(n, names)} AS {name}" for name, n in formulas.items())])
    return f"WITH {prelude + ', ' if prelude else ''}{', '.join(steps)} SELECT {out} FROM {last}"
