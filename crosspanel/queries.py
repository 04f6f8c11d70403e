"""Queries over the driver's tables and their SQL twins, one for each operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.history import ROW, numbered
from .plans.artifact_catalogue import ARTIFACTS, artifact
from .plans.catalogue import BASES, CONTROLS, control_signal
from .plans.compiler import evaluate, evaluate_observed
from .plans.expr import Node, parse
from .plans.twin import evaluate_sql
from .sources.panel import densify, trade_panel, trade_panel_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6, signed: bool = False) -> DataFrame:
    """Doubles rounded, so that sums in another order agree. Zeros are positive, or ``signed`` like what they are rounded from."""

    def near(c: str) -> Column:
        value = F.round(c, digits)
        return F.when(value == 0, F.col(c) * 0.0).otherwise(value) if signed else value

    return df.select(*(near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(name: str, query: Query, sql: str | None = None, dates: tuple[str, ...] = ()) -> None:
    """Add a query and its twin. Columns in ``dates`` are given as text, which reads the same in both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in dates)}) FROM ({sql})" if dates else sql


def _formula(name: str, formula: Node, by: str = "supplier", period: str = "week", axis: str = "dense", digits: int = 6, signed: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = trade_panel(spark, sf_dir, period, by)
        if axis == "dense":
            return rounded(evaluate_observed(panel, {"value": formula}), digits, signed)
        return rounded(evaluate(panel, {"value": formula}), digits, signed)

    sql = evaluate_sql(axis, {"value": formula}, prelude=trade_panel_sql(period, by), digits=digits) + (" WHERE observed" if axis == "dense" else "")
    register(name, query, sql, ("date",))


# ---- operators of the formula language: on the weekly supplier panel, which has gaps ----
_OPERATORS = {
    "ts_delay": "delay(log(close), 3)", "ts_lead": "lead(log(open), 2)", "ts_delta": "delta(volume, 2)", "ts_sum": "ts_sum(volume, 5)", "ts_mean": "ts_mean(log(close), 4)", "ts_std": "stddev(close, 5)",
    "ts_std_one_day": "stddev(close, 1)", "ts_std_pop": "stddev_pop(close, 5)", "ts_var": "ts_var(returns, 6)", "ts_min": "ts_min(log(low), 4)", "ts_max": "ts_max(log(high), 4)", "ts_rank": "ts_rank(volume, 6)",
    "ts_argmax": "ts_argmax(high, 5)", "ts_argmin": "ts_argmin(low, 5)", "ts_corr": "correlation(open, volume, 5)", "ts_cov": "covariance(log(close), volume, 5)", "ts_decay_linear": "decay_linear(log(close), 4)",
    "ts_product": "product(close / open, 3)", "ts_adv": "adv(5)", "ts_median": "ts_median(volume, 5)", "ts_count": "ts_count(returns, 5)", "ts_mean_min_periods": "mean_min(returns, 8, 3)",
    "ts_std_min_periods": "std_min(returns, 8, 3)", "ts_sum_min_periods": "sum_min(volume, 8, 2)", "ts_max_min_periods": "max_min(log(high), 8, 2)", "ts_var_min_periods": "var_min(returns, 8, 3)", "ts_median_min_periods": "median_min(volume, 8, 3)", "ts_std_pop_min_periods": "stdp_min(returns, 8, 3)",
    "ts_pct_change": "pct_change(close, 1)", "ts_ewm_adjusted": "ewm(close, 3)", "ts_cummax": "cummax(log(high))", "ts_drawdown": "1 - cumprod(1 + fill(returns * 0.01, 0)) / cummax(cumprod(1 + fill(returns * 0.01, 0)))",
    "cs_rank": "rank(close)", "cs_rank_ties": "rank(sign(returns))", "cs_average_rank": "avgrank(volume)", "cs_rank_centered": "rank_centered(returns)", "cs_rank_mid": "midrank(volume)", "cs_rank_half": "rank(close) - 0.5",
    "cs_scale": "scale(returns, 2)", "cs_demean": "demean(log(close))", "cs_zscore": "zscore(volume)", "cs_zscore_eps": "zscore_eps(returns, 0.00000001)", "cs_zscore_guarded": "zscore_zero(volume, 0.000000000001)", "cs_zscore_filled": "zscore_fill(returns)",
    "cs_zscore_pop": "zscore_pop(volume, 20, 0.000000000001)", "cs_market_mean": "xmean(returns, 20)", "cs_count": "xcount(returns)", "cs_dispersion": "xstd(returns)", "cs_mask_thin": "least_names(log(close), 60)",
    "cs_rank_demeaned": "demean(rank(close))", "cs_rank_of_ranks": "rank((0.5 - rank(close)) * (1 - rank(volume))) - 0.5",
    "row_less": "close < open", "row_greater": "close > open", "row_less_equal": "returns <= 0", "row_greater_equal": "volume >= 20", "row_where": "where(returns < 0, log(close), volume)", "row_min": "emin(log(close), delay(log(close), 1))", "row_max": "emax(log(close), delay(log(close), 1))",
    "row_signed_power": "signedpower(returns, 0.5)", "row_power": "power(rank(close), rank(volume))", "row_log": "log(returns)", "row_sign": "sign(returns)", "row_abs": "abs(returns)", "row_ieee_divide": "returns / (sign(volume - 20) * 1)",
    "row_safe_divide": "safediv(close, returns)", "row_sqrt": "sqrt(returns)", "row_log1p": "log1p(returns)", "row_expm1": "expm1(clip(returns, -1, 3))", "row_tanh": "tanh(returns)", "row_fill": "fill(returns, 0)", "row_clip": "clip(returns, -0.2, 0.2)",
    "row_drop_infinite": "isfinite(returns / (sign(volume - 20) * 1))", "ts_sum_skips_infinite": "ts_sum(returns / (sign(volume - 20) * 1), 2)", "ts_true_range": "rowmax(log(high) - log(low), abs(log(high) - delay(log(close), 1)), abs(log(low) - delay(log(close), 1)))",
    "ts_market_roll": "ts_sum(xmean(returns, 1), 4)", "ts_rolling_beta": "(ts_mean(returns * xmean(returns), 12) - ts_mean(returns, 12) * ts_mean(xmean(returns), 12)) / ts_var(xmean(returns), 12)",
}
for _name, _text in _OPERATORS.items():
    _formula(_name, parse(_text), signed=_name == "row_ieee_divide")  # a quotient's zero has its sign, as its infinities have
_formula("ts_delay_row_axis", parse("delay(log(close), 3)"), axis="panel")
_formula("ts_ewm_recursive", parse("ewm_rec(close, 3)"))
_formula("ts_market_sum", parse("market_sum(xmean(returns), 4)"), axis="panel")
_formula("ts_cumcount", parse("cumcount(returns)"))
_formula("row_only", parse("only(returns > 0, log(close))"))
_formula("row_pick", parse("pick(returns > 0, log(close), volume)"))

# ---- the same windows over blocks of time, so that a long history is the work of many tasks ----
_BLOCKED = parse("ts_mean(log(close), 4) - ts_max(delay(log(low), 2), 3) + rank(correlation(open, volume, 5)) + ts_rank(volume, 6) * ts_median(volume, 5)")


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = densify(trade_panel(spark, sf_dir))
    return rounded(evaluate(dense, {"value": _BLOCKED}, ("observed",), block_rows=48).filter("observed").drop("observed"))


register("ts_blocks_of_time", _blocked, evaluate_sql("dense", {"value": _BLOCKED}, prelude=trade_panel_sql()) + " WHERE observed", ("date",))
register("ts_row_numbers", lambda s, d: numbered(trade_panel(s, d)).select("date", "symbol", F.col(ROW).alias("n")), f"WITH {trade_panel_sql()} SELECT date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM panel", ("date",))

# ---- formula catalogues: on the weekly nation panel, which is dense enough for long windows ----
for _name in CONTROLS:
    _formula(f"alpha_{_name}", control_signal(_name), by="nation", digits=10)
for _name, _text in BASES.items():  # the longest window takes 756 rows of a symbol: more days than the test tables have weeks
    _formula(f"base_{_name}", parse(f"rank({_text}) - 0.5"), by="nation", period="day" if "756" in _text else "week", axis="panel")
# the artifacts count a symbol's own rows; suppliers have enough of them for the longest windows
for _name, (_, _text, _) in ARTIFACTS.items():
    if _text is not None:  # the one that can't be built with its own defaults runs with a shorter minimum
        _formula(f"artifact_{_name.removeprefix('alpha_')}", artifact(_name, **({"min_obs": 60} if _name == "alpha_a728eba6" else {})), axis="panel")

# ---- all published formulas in one plan ----
_BATCH = {_name: control_signal(_name) for _name in CONTROLS}


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = evaluate_observed(trade_panel(spark, sf_dir, "week", "nation"), _BATCH)
    return wide.agg(*(F.count(n).alias(n) for n in _BATCH)).unpivot([], list(_BATCH), "alpha_id", "n_signals")


register(
    "control_batch", _batch,
    f"UNPIVOT (SELECT {', '.join(f'count({n}) AS {n}' for n in _BATCH)} FROM ({evaluate_sql('dense', _BATCH, ('observed',), prelude=trade_panel_sql('week', 'nation'), digits=None)}) WHERE observed) ON {', '.join(_BATCH)} INTO NAME alpha_id VALUE n_signals",
)


def _batch_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = evaluate_observed(trade_panel(spark, sf_dir, "week", "nation"), _BATCH)
    return rounded(wide.unpivot(["date", "symbol"], list(_BATCH), "alpha_id", "value"), 8)


register(
    "control_batch_values", _batch_values,
    f"SELECT * FROM (SELECT date, symbol, {', '.join(f'round({n}, 8) AS {n}' for n in _BATCH)} FROM ({evaluate_sql('dense', _BATCH, ('observed',), prelude=trade_panel_sql('week', 'nation'), digits=None)}) WHERE observed) UNPIVOT INCLUDE NULLS (value FOR alpha_id IN ({', '.join(_BATCH)}))",
    ("date",),
)
