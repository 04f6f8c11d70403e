"""Queries of the signal evaluation and of test 1, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import decay as D
from .operators import evaluate as E
from .operators.screening import Signal, screening_table
from .plans.compiler import evaluate, evaluate_observed, neutral, rank_products
from .plans.expr import call, field, parse
from .plans.twin import evaluate_sql
from .queries import register, rounded
from .sources.cache import kept
from .sources.panel import densify, trade_panel, trade_panel_sql

# Signals for the test tables: short windows, since the weekly supplier panel has gaps.
CONTROL_SET = {
    "c01": "rank(-1 * (1 - open / close))", "c02": "(close - open) / ((high - low) + 0.001)", "c03": "sign(delta(volume, 1)) * (-1 * delta(close, 1))", "c04": "-1 * ts_rank(rank(low), 3)",
    "c05": "-1 * delta(log(close), 1)", "c06": "rank(volume)", "c07": "returns", "c08": "-1 * ts_mean(returns, 3)", "c09": "rank(close) * rank(volume)", "c10": "(high - close) / (high - low)",
    "c11": "close / ts_max(close, 4)", "c12": "-1 * stddev(returns, 3)", "c13": "ts_rank(volume, 4)", "c14": "log(high / low)",
}
TREATED_SET = {"a01": "rank(returns) * rank(volume)", "a02": "close / open", "a03": "-1 * delta(volume, 2)"}
CUTOFF = "2001-01-01"
_ALL = {k: parse(v) for k, v in (CONTROL_SET | TREATED_SET).items()}


#: The forward return from the open of the next date to that of the one after, as one more formula of the batch.
FORWARD = parse("isfinite(lead(open, 2) / lead(open, 1) - 1)")


def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of all signals on observed rows. Ranks that come last are taken with the correlations, a date's rows at once."""
    columns, products = rank_products(_ALL)
    wide = evaluate_observed(trade_panel(spark, sf_dir), columns | {"fwd": FORWARD}, by="date")
    return E.rank_ic_wide(wide, list(_ALL), products=products)


def ic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rank correlations of all signals: the tests' common input, a row for each signal and date, written once."""

    def make() -> DataFrame:
        return daily_ic(spark, sf_dir).select("alpha_id", "date", "ic")

    return kept("ic", spark, sf_dir, make)


def leak_signals(w: float):
    """A base signal blended with the future: w (rank of the forward return - 1/2) + (1 - w) (rank of the base - 1/2)."""
    ahead = call("sub", call("div", call("lead", field("open"), numbers=(2,)), call("lead", field("open"), numbers=(1,))), parse("1"))
    rank = lambda n: call("sub", call("rank", n), parse("0.5"))
    blend = call("add", call("mul", parse(str(w)), rank(ahead)), call("mul", parse(str(1 - w)), rank(parse("-1 * (close / delay(close, 5) - 1)"))))
    return blend


_PRELUDE = trade_panel_sql() + ",\nwide AS (" + evaluate_sql("dense", _ALL, ("observed",), digits=None) + ")" + """,
signals AS (
  UNPIVOT (SELECT * EXCLUDE observed FROM wide WHERE observed) ON """ + ", ".join(_ALL) + """ INTO NAME alpha_id VALUE signal
), fwd AS (
  SELECT date, symbol, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS fwd FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY date)
), joint AS (
  SELECT * FROM signals JOIN fwd USING (date, symbol) WHERE signal IS NOT NULL AND fwd IS NOT NULL
), ranked AS (
  SELECT alpha_id, date,
         rank() OVER (PARTITION BY alpha_id, date ORDER BY signal) + (count(*) OVER (PARTITION BY alpha_id, date, signal) - 1) / 2.0 AS a,
         rank() OVER (PARTITION BY alpha_id, date ORDER BY fwd) + (count(*) OVER (PARTITION BY alpha_id, date, fwd) - 1) / 2.0 AS b
  FROM joint
), ics AS MATERIALIZED (
  SELECT * FROM (SELECT alpha_id, date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic, count(*) AS n_names FROM ranked GROUP BY ALL)
  WHERE n_names >= 20 AND ic IS NOT NULL
)"""

for _name, _expr in (("open_t1", "lead(open, 2) OVER w / lead(open, 1) OVER w - 1"), ("close_t1", "lead(close, 2) OVER w / lead(close, 1) OVER w - 1"), ("same_close", "lead(close, 1) OVER w / close - 1")):
    register(
        f"forward_returns_{_name}",
        lambda spark, sf_dir, c=_name: rounded(E.forward_returns(densify(trade_panel(spark, sf_dir)), c)),
        f"WITH {trade_panel_sql()} SELECT date, symbol, round({_expr}, 6) AS fwd FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY date)",
        ("date",),
    )


def _ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily_ic(spark, sf_dir))


register("rank_ic_daily", _ic_daily, f"WITH {_PRELUDE} SELECT alpha_id, date, round(ic, 6) AS ic, n_names FROM ics", ("date",))
register(
    "ic_summary",
    lambda spark, sf_dir: rounded(E.ic_summary(ic_panel(spark, sf_dir))),
    f"""WITH {_PRELUDE} SELECT alpha_id, count(*) AS ic_n_days, round(avg(ic), 6) AS mean_rank_ic, round(stddev_samp(ic), 6) AS ic_std,
    round(avg(ic) / stddev_samp(ic), 6) AS ic_information_ratio FROM ics GROUP BY alpha_id HAVING count(*) >= 3""",
)


def _leak_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    formulas = {f"w{round(100 * w):02d}": leak_signals(w) for w in (0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20)}
    panel = trade_panel(spark, sf_dir)
    wide = evaluate(panel, formulas).join(E.forward_returns(densify(panel)), ["date", "symbol"])
    ic = E.rank_ic_wide(wide.filter(F.col("date") < F.lit(CUTOFF).cast("date")), list(formulas))
    return rounded(E.ic_summary(ic).select("alpha_id", "mean_rank_ic"))


_LEAKS = {f"w{round(100 * w):02d}": leak_signals(w) for w in (0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20)}
register(
    "leak_power_curve",
    _leak_curve,
    f"""WITH {trade_panel_sql()}, wide AS ({evaluate_sql("panel", _LEAKS, digits=None)}), signals AS (UNPIVOT wide ON {", ".join(_LEAKS)} INTO NAME alpha_id VALUE signal),
    fwd AS (SELECT date, symbol, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS fwd FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    ranked AS (SELECT alpha_id, date, rank() OVER (PARTITION BY alpha_id, date ORDER BY signal) + (count(*) OVER (PARTITION BY alpha_id, date, signal) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY alpha_id, date ORDER BY fwd) + (count(*) OVER (PARTITION BY alpha_id, date, fwd) - 1) / 2.0 AS b
      FROM signals JOIN fwd USING (date, symbol) WHERE signal IS NOT NULL AND fwd IS NOT NULL AND date < '{CUTOFF}'),
    ics AS (SELECT alpha_id, date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM ranked GROUP BY ALL HAVING count(*) >= 20)
    SELECT alpha_id, round(avg(ic), 6) AS mean_rank_ic FROM ics GROUP BY alpha_id""",
)


# ---- portfolio ----
_WEIGHTS = {k: neutral(_ALL[k]) for k in ("c01", "c06", "c12", "a01", "a02")}


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = trade_panel(spark, sf_dir)
    wide = evaluate_observed(panel, _WEIGHTS, ("returns",))
    return E.portfolio_returns_wide(wide, list(_WEIGHTS))


_PORTFOLIO = trade_panel_sql() + ",\nwide AS (" + evaluate_sql("dense", _WEIGHTS, ("observed",), digits=None) + ")" + """,
seen AS (SELECT * EXCLUDE observed FROM wide WHERE observed),
signals AS (SELECT * FROM seen UNPIVOT INCLUDE NULLS (signal FOR alpha_id IN (""" + ", ".join(_WEIGHTS) + """))),
daily AS MATERIALIZED (
  SELECT alpha_id, date, coalesce(sum(weight * returns), 0) AS ret
  FROM (SELECT *, lag(signal) OVER (PARTITION BY alpha_id, symbol ORDER BY date) AS weight FROM signals) JOIN panel USING (date, symbol) GROUP BY ALL
), perf AS (
  SELECT alpha_id, avg(ret) * 252 AS annualized_return, stddev_samp(ret) * sqrt(252) AS annualized_vol, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252) AS sharpe_ratio, count(*) AS n_days,
         coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS daily_sharpe,
         (avg(ret ** 3) - 3 * avg(ret) * avg(ret ** 2) + 2 * avg(ret) ** 3) / nullif(stddev_pop(ret), 0) ** 3 AS skew, kurtosis_pop(ret) + 3 AS kurtosis
  FROM daily GROUP BY alpha_id
)"""
register("portfolio_returns", lambda spark, sf_dir: rounded(daily_returns(spark, sf_dir)), f"WITH {_PORTFOLIO} SELECT alpha_id, date, round(ret, 6) AS ret FROM daily", ("date",))
register(
    "performance",
    lambda spark, sf_dir: rounded(E.performance(daily_returns(spark, sf_dir)), 4),
    f"WITH {_PORTFOLIO} SELECT alpha_id, n_days, {', '.join(f'round({c}, 4) AS {c}' for c in ('annualized_return', 'annualized_vol', 'sharpe_ratio', 'daily_sharpe', 'skew', 'kurtosis'))} FROM perf",
)


def _artifact_models(spark: SparkSession) -> DataFrame:
    rows = [(k, "control" if k in CONTROL_SET else "treatment") for k in _WEIGHTS]
    return spark.createDataFrame(rows, "alpha_id string, model string")


def screening(spark: SparkSession, sf_dir: str, level: float = 0.95) -> DataFrame:
    models = _artifact_models(spark)
    done = E.performance(daily_returns(spark, sf_dir)).join(F.broadcast(models), "alpha_id")
    return rounded(E.screen(done, E.trials_per_model(models), level).select("alpha_id", "model", "n_trials", "dsr_z_score", "dsr", "status"), 4)


_N = {m: sum((k in CONTROL_SET) == (m == "control") for k in _WEIGHTS) for m in ("control", "treatment")}
# What the best of three and of two worthless signals is expected to reach, in standard errors:
# (1 - g) q(1 - 1 / n) + g q(1 - 1 / (n e)) with g = 0.5772156649, q(2/3) = 0.4307272993, q(1 - 1 / 3e) = 1.1619569289, q(1/2) = 0, q(1 - 1 / 2e) = 0.9004525966.
_BEST = {"control": 0.8528044961, "treatment": 0.5197553443}
_DSR = f"""m AS (SELECT *, CASE WHEN alpha_id LIKE 'c%' THEN 'control' ELSE 'treatment' END AS model FROM perf),
    n AS (SELECT *, CASE model WHEN 'control' THEN {_N["control"]} ELSE {_N["treatment"]} END::BIGINT AS n_trials, CASE model WHEN 'control' THEN {_BEST["control"]} ELSE {_BEST["treatment"]} END AS best FROM m),
    zs AS (SELECT *, (daily_sharpe - best / sqrt(n_days)) * sqrt(n_days - 1) / sqrt(1 - skew * daily_sharpe + (kurtosis - 1) / 4 * daily_sharpe ** 2) AS z FROM n)"""
register(
    "screening",
    screening,
    # the normal distribution function by Simpson's rule on [0, |z|]
    f"""WITH {_PORTFOLIO}, {_DSR}, areas AS (
      SELECT *, 0.5 + sign(z) * abs(z) / 6000 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * k / 2000, 2) / 2))) / sqrt(2 * pi()) AS p FROM zs
    ) SELECT alpha_id, model, n_trials, round(z, 4) AS dsr_z_score, round(least(0.9999, greatest(0.0001, p)), 4) AS dsr, CASE WHEN p > 0.95 THEN 'SURVIVED_PHASE_1' ELSE 'REJECTED_DSR' END AS status FROM areas""",
)
register(
    "deflated_sharpe_z",
    lambda spark, sf_dir: screening(spark, sf_dir).select("alpha_id", "model", "n_trials", "dsr_z_score"),
    f"WITH {_PORTFOLIO}, {_DSR} SELECT alpha_id, model, n_trials, round(z, 4) AS dsr_z_score FROM zs",
)

# ---- the whole screening table, with signals that fail when they are built, analysed and run ----
def _duplicated(panel: DataFrame) -> DataFrame:
    return panel.unionByName(panel).select("date", "symbol", F.col("close").alias("signal"))


def _over_own_mean(panel: DataFrame) -> DataFrame:
    own = panel.groupBy("symbol").agg(F.avg("close").alias("m"))
    return panel.join(own, "symbol").select("date", "symbol", (F.col("close") / F.col("m") - 1).alias("signal"))


_PLUGINS = [
    Signal("p01", lambda p: F.col("volume") - F.avg("volume").over(Window.partitionBy("date")), "plugin", "volume"), Signal("p02", _over_own_mean, "plugin", "level"),
    Signal("f01", lambda p: F.col("earnings") / F.col("close"), "plugin", "unknown column"), Signal("f02", lambda p: F.col("volume").cast("int") * F.lit(2147483647), "plugin", "overflow"),
    Signal("f03", "mean_min(returns, 60, 126)", "plugin", "window"), Signal("f04", _duplicated, "plugin", "duplicates"),
]


def _whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = [Signal(k, w, "control" if k in CONTROL_SET else "treatment") for k, w in _WEIGHTS.items()]
    reason = F.regexp_extract("error", r"^(\[[A-Z0-9_.]+\]|\w+)", 1)
    # demeaning may part or join products that are equal but for rounding, so ranks, and means of correlations, agree to three digits only
    coarse = {c: F.round(c, 3) for c in ("mean_rank_ic", "ic_std", "ic_information_ratio")}
    return rounded(screening_table(trade_panel(spark, sf_dir), [*mine, *_PLUGINS], digits={}).withColumns({"error": reason} | coarse), 4)


# The same expectation for six trials, with q(1 - 1 / 6) = 0.9674215661 and q(1 - 1 / 6e) = 1.5438425505.
_BEST |= {"plugin": 1.3001407878}
register(
    "screening_table", _whole_table,
    f"""WITH {_PORTFOLIO.replace("signals AS (SELECT", "formulas AS (SELECT").replace("daily AS MATERIALIZED", """signals AS (
      SELECT alpha_id, date, symbol, signal FROM formulas
      UNION ALL SELECT 'p01', date, symbol, volume - avg(volume) OVER (PARTITION BY date) FROM panel
      UNION ALL SELECT 'p02', date, symbol, close / avg(close) OVER (PARTITION BY symbol) - 1 FROM panel
    ), daily AS MATERIALIZED""")},
    m AS (SELECT *, CASE alpha_id[1] WHEN 'c' THEN 'control' WHEN 'a' THEN 'treatment' ELSE 'plugin' END AS model FROM perf),
    n AS (SELECT *, CASE model WHEN 'control' THEN {_BEST["control"]} WHEN 'treatment' THEN {_BEST["treatment"]} ELSE {_BEST["plugin"]} END AS best FROM m),
    zs AS (SELECT *, (daily_sharpe - best / sqrt(n_days)) * sqrt(n_days - 1) / sqrt(1 - skew * daily_sharpe + (kurtosis - 1) / 4 * daily_sharpe ** 2) AS z FROM n),
    areas AS (
      SELECT *, 0.5 + sign(z) * abs(z) / 6000 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * k / 2000, 2) / 2))) / sqrt(2 * pi()) AS p FROM zs
    ), fwd AS (SELECT date, symbol, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS fwd FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    joint AS (SELECT * FROM signals JOIN fwd USING (date, symbol) WHERE signal IS NOT NULL AND fwd IS NOT NULL),
    ranked AS (SELECT alpha_id, date, rank() OVER (PARTITION BY alpha_id, date ORDER BY signal) + (count(*) OVER (PARTITION BY alpha_id, date, signal) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY alpha_id, date ORDER BY fwd) + (count(*) OVER (PARTITION BY alpha_id, date, fwd) - 1) / 2.0 AS b FROM joint),
    ics AS (SELECT alpha_id, date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM ranked GROUP BY ALL HAVING count(*) >= 20),
    sums AS (SELECT alpha_id, count(ic) AS ic_n_days, avg(ic) AS m, stddev_samp(ic) AS s FROM ics GROUP BY alpha_id)
    SELECT alpha_id, model, CASE alpha_id WHEN 'p01' THEN 'volume' WHEN 'p02' THEN 'level' END AS theme, round(annualized_return, 4) AS annualized_return, round(annualized_vol, 4) AS annualized_vol, round(sharpe_ratio, 4) AS sharpe_ratio,
      round(z, 4) AS dsr_z_score, round(least(0.9999, greatest(0.0001, p)), 4) AS dsr, 'open_t1' AS ic_execution, round(m, 3) AS mean_rank_ic, round(s, 3) AS ic_std, round(m / s, 3) AS ic_information_ratio, ic_n_days,
      CASE WHEN p > 0.95 THEN 'SURVIVED_PHASE_1' ELSE 'REJECTED_DSR' END AS status, NULL AS error FROM areas JOIN sums USING (alpha_id)
    UNION ALL SELECT a, 'plugin', t, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 'FAILED_EXECUTION', e
    FROM (VALUES ('f01', 'unknown column', '[UNRESOLVED_COLUMN.WITH_SUGGESTION]'), ('f02', 'overflow', '[ARITHMETIC_OVERFLOW]'), ('f03', 'window', 'ValueError'), ('f04', 'duplicates', '[USER_RAISED_EXCEPTION]')) t(a, t, e)""",
)

# ---- test 1 ----
_TEST1 = _PRELUDE + f""",
ctrl AS (SELECT date, avg(ic) AS bench FROM ics WHERE alpha_id LIKE 'c%' GROUP BY date),
shared AS (SELECT date FROM ics WHERE alpha_id LIKE 'c%' INTERSECT SELECT date FROM ics WHERE alpha_id LIKE 'a%'),
benched AS (
  SELECT 'treatment' AS arm, alpha_id, date, ic, bench FROM ics JOIN ctrl USING (date) JOIN shared USING (date) WHERE alpha_id LIKE 'a%'
  UNION ALL
  SELECT 'control', c.alpha_id, c.date, c.ic, avg(o.ic) FROM ics c JOIN shared USING (date) JOIN ics o ON o.date = c.date AND o.alpha_id <> c.alpha_id AND o.alpha_id LIKE 'c%' WHERE c.alpha_id LIKE 'c%' GROUP BY ALL
), slopes AS (
  SELECT alpha_id, CASE WHEN count(*) > 30 THEN coalesce(covar_pop(ic, bench) / nullif(var_pop(bench), 0), 0) ELSE 0 END AS beta FROM benched WHERE date < '{CUTOFF}' GROUP BY alpha_id
), diff AS MATERIALIZED (
  SELECT arm, alpha_id, date, ic - coalesce(beta, 0) * bench AS d FROM benched LEFT JOIN slopes USING (alpha_id)
), period AS (SELECT count(DISTINCT date) AS L FROM diff WHERE date >= '{CUTOFF}'),
oos AS (SELECT arm, alpha_id, avg(d) AS oos_mean, sqrt(greatest(var_pop(d), 1e-14) / count(*)) AS oos_se, count(*) AS n FROM diff WHERE date >= '{CUTOFF}' GROUP BY ALL),
past AS (SELECT *, row_number() OVER (PARTITION BY arm, alpha_id ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY arm, alpha_id) AS is_n FROM diff WHERE date < '{CUTOFF}'),
base AS (
  SELECT arm, alpha_id, b, avg(d) AS base_mean, CASE WHEN count(*) >= 5 THEN sqrt(greatest(var_pop(d), 1e-14) / count(*)) END AS base_se
  FROM past, period, (SELECT unnest([2, 3, 4, 5, 6, 7, 8]) AS b) WHERE back <= b * L AND is_n >= L GROUP BY ALL
), tvals AS MATERIALIZED (
  SELECT arm, alpha_id, b, base_mean, oos_mean, (base_mean - oos_mean) / sqrt(base_se ** 2 + oos_se ** 2) AS t FROM base JOIN oos USING (arm, alpha_id) WHERE n >= 5
), crits AS (
  SELECT b, list_sort(list(t))[ceil(0.95 * (count(*) - 1))::INT + 1] AS crit FROM tvals WHERE arm = 'control' GROUP BY b
), rivals AS (
  SELECT c.alpha_id, c.b, c.t, list_sort(list(o.t))[ceil(round(0.95 * (count(*) - 1), 9))::INT + 1] AS crit FROM tvals c JOIN tvals o ON c.b = o.b AND c.alpha_id <> o.alpha_id WHERE c.arm = 'control' AND o.arm = 'control' GROUP BY ALL
), cvotes AS (SELECT alpha_id, count(*) FILTER (t > crit) AS votes FROM rivals GROUP BY alpha_id),
tvotes AS (SELECT alpha_id, count(*) FILTER (t > crit) AS votes FROM tvals JOIN crits USING (b) WHERE arm = 'treatment' GROUP BY alpha_id),
curve AS (SELECT k, avg((votes >= k)::INT) AS fpr FROM cvotes, (SELECT unnest(range(1, 8)) AS k) GROUP BY k),
kmin AS (SELECT coalesce(min(k), 4) AS k_min FROM curve WHERE fpr <= 0.05)"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arms(ic_panel(spark, sf_dir), list(TREATED_SET), list(CONTROL_SET), CUTOFF)


def t_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept("t", spark, sf_dir, lambda: D.decay_t(arms(spark, sf_dir), CUTOFF))


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ic_panel(spark, sf_dir).filter("alpha_id like 'c%'")


def _test1(name: str, query, sql: str, dates: tuple[str, ...] = ()) -> None:
    register(name, query, f"WITH {_TEST1} {sql}", dates)


_test1("control_mean", lambda s, d: rounded(D.control_mean(_controls(s, d))), "SELECT date, round(bench, 6) AS bench FROM ctrl", ("date",))
_test1("others_mean", lambda s, d: rounded(D.others_mean(_controls(s, d)).select("alpha_id", "date", "bench")), "SELECT c.alpha_id, c.date, round(avg(o.ic), 6) AS bench FROM ics c LEFT JOIN ics o ON o.date = c.date AND o.alpha_id <> c.alpha_id AND o.alpha_id LIKE 'c%' WHERE c.alpha_id LIKE 'c%' GROUP BY ALL", ("date",))
_test1("in_sample_beta", lambda s, d: rounded(D.betas(D.others_mean(_controls(s, d)), CUTOFF), 5), f"SELECT c.alpha_id, round(covar_pop(c.ic, m) / var_pop(m), 5) AS beta FROM (SELECT c.alpha_id, c.date, c.ic, avg(o.ic) AS m FROM ics c JOIN ics o ON o.date = c.date AND o.alpha_id <> c.alpha_id AND o.alpha_id LIKE 'c%' WHERE c.alpha_id LIKE 'c%' AND c.date < '{CUTOFF}' GROUP BY ALL) c GROUP BY 1")
_test1("differentials", lambda s, d: rounded(arms(s, d)), "SELECT arm, alpha_id, date, round(d, 6) AS d FROM diff", ("date",))
_test1("excess_decay_t", lambda s, d: rounded(t_values(s, d), 5), "SELECT arm, alpha_id, b, round(base_mean, 5) AS base_mean, round(oos_mean, 5) AS oos_mean, round(t, 5) AS t FROM tvals")
_test1("critical_t", lambda s, d: rounded(D.critical(t_values(s, d)), 5), "SELECT b, round(crit, 5) AS crit FROM crits")
_test1("others_critical_t", lambda s, d: rounded(D.others_critical(t_values(s, d)).select("alpha_id", "b", "crit"), 5), "SELECT alpha_id, b, round(crit, 5) AS crit FROM rivals")
_test1("treatment_p", lambda s, d: rounded(D.treatment_p(t_values(s, d))), "SELECT a.alpha_id, a.b, round((1 + count(*) FILTER (c.t >= a.t)) / (1.0 + count(*)), 6) AS p FROM tvals a JOIN tvals c USING (b) WHERE a.arm = 'treatment' AND c.arm = 'control' GROUP BY ALL")
_test1("control_votes", lambda s, d: D.control_votes(t_values(s, d)), "SELECT * FROM cvotes")
_test1("treatment_votes", lambda s, d: D.treatment_votes(t_values(s, d)), "SELECT * FROM tvotes")
_test1("false_positive_curve", lambda s, d: rounded(D.false_positive_curve(D.control_votes(t_values(s, d)))), "SELECT k, round(fpr, 6) AS fpr FROM curve")
_test1("least_votes", lambda s, d: D.least_votes(D.control_votes(t_values(s, d))), "SELECT k_min FROM kmin")
_test1("decay_verdicts", lambda s, d: rounded(D.verdicts(t_values(s, d)), 5), "SELECT alpha_id, votes, CASE WHEN votes >= k_min THEN 'FAILED' ELSE 'PASSED' END AS verdict, round(base_mean, 5) AS base_mean, round(oos_mean, 5) AS oos_mean FROM tvotes JOIN tvals USING (alpha_id), kmin WHERE b = 5")
# three signals against fourteen: p counts the triples of ranks whose sum is as large as theirs
_test1("rank_sum_pool", lambda s, d: rounded(D.rank_sum(t_values(s, d)), 5), """, p AS (SELECT arm, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY t) AS tied FROM tvals WHERE b = 5 AND t IS NOT NULL),
s AS (SELECT count(*) FILTER (arm = 'treatment') AS m, count(*) FILTER (arm = 'control') AS n, sum(r) FILTER (arm = 'treatment') AS s, sum(tied * tied - 1) AS ties FROM p),
draws AS (SELECT a.r + b.r + c.r AS total FROM p a JOIN p b ON a.r < b.r JOIN p c ON b.r < c.r)
SELECT m AS n_treatment, n AS n_control, round(s - m * (m + 1) / 2, 5) AS u, round((s - m * (m + 1) / 2 - m * n / 2 - 0.5) / sqrt(m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1)))), 5) AS z,
(SELECT round(avg((total >= s)::INT), 5) FROM draws) AS p FROM s""")
_test1("mean_pairwise_corr", lambda s, d: rounded(D.mean_pairwise_correlation(_controls(s, d))), "SELECT count(c) AS n_pairs, round(avg(c), 6) AS mean_corr FROM (SELECT corr(a.ic, b.ic) AS c FROM ics a JOIN ics b ON a.date = b.date AND a.alpha_id < b.alpha_id WHERE a.alpha_id LIKE 'c%' AND b.alpha_id LIKE 'c%' GROUP BY a.alpha_id, b.alpha_id)")
_test1("pairwise_corr", lambda s, d: rounded(D.pairwise_correlations(ic_panel(s, d))), "SELECT a.alpha_id AS a, b.alpha_id AS b, round(corr(a.ic, b.ic), 6) AS corr FROM ics a JOIN ics b ON a.date = b.date AND a.alpha_id < b.alpha_id GROUP BY ALL")
_test1("correlation_range", lambda s, d: rounded(D.correlation_range(ic_panel(s, d))), "SELECT count(c) AS n_pairs, round(median(c), 6) AS median_corr, round(min(c), 6) AS least_corr, round(max(c), 6) AS greatest_corr FROM (SELECT corr(a.ic, b.ic) AS c FROM ics a JOIN ics b ON a.date = b.date AND a.alpha_id < b.alpha_id GROUP BY a.alpha_id, b.alpha_id)")
_test1("two_sample_ks", lambda s, d: rounded(D.two_sample_ks(t_values(s, d).filter("b = 5").select(F.col("t").alias("x"), (F.col("arm") == "treatment").alias("first")))), "SELECT round(max(abs(x)), 6) AS ks FROM (SELECT (SELECT avg((o.t <= v.t)::INT) FROM tvals o WHERE b = 5 AND arm = 'treatment') - (SELECT avg((o.t <= v.t)::INT) FROM tvals o WHERE b = 5 AND arm = 'control') AS x FROM tvals v WHERE b = 5)")
