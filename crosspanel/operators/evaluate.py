"""Scoring signals: forward returns, daily rank correlation, portfolio statistics, deflated Sharpe ratio.

Signals are long, (alpha_id, date, symbol, signal), so that many are scored in one plan.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import finite
from .series import average_rank

CONVENTIONS = ("open_t1", "close_t1", "same_close")
# What the screening table calls a signal.
SURVIVED, REJECTED, FAILED = "SURVIVED_PHASE_1", "REJECTED_DSR", "FAILED_EXECUTION"
EULER = 0.5772156649
DAYS = 252


def forward_return(convention: str = "open_t1") -> Column:
    """A filled row's forward return: open or close of t + 1 to t + 2, or close of t to t + 1."""
    if convention not in CONVENTIONS:
        raise ValueError(f"convention must be one of {CONVENTIONS}, not {convention!r}")
    price, first = (F.col("open") if convention == "open_t1" else F.col("close")), (0 if convention == "same_close" else 1)
    w = Window.partitionBy("symbol").orderBy("date")
    start = F.lead(price, first).over(w) if first else price
    return finite(F.lead(price, first + 1).over(w) / F.when(start != 0, start) - 1)


def forward_returns(dense: DataFrame, convention: str = "open_t1") -> DataFrame:
    """``date, symbol, fwd`` on market dates: open or close of t + 1 to t + 2, or close of t to t + 1."""
    return dense.select("date", "symbol", forward_return(convention).alias("fwd"))


def long_signals(wide: DataFrame, names: list[str]) -> DataFrame:
    """``alpha_id, date, symbol, signal`` from a column for each signal."""
    return wide.unpivot(["date", "symbol"], names, "alpha_id", "signal").select("alpha_id", "date", "symbol", "signal")


def rank_ic(signals: DataFrame, forward: DataFrame, min_names: int = 20) -> DataFrame:
    """``alpha_id, date, ic, n_names``: correlation of the ranks of signal and forward return among names that have both.

    Ranks are taken after masking, ties averaged. Dates with fewer than ``min_names`` names or without spread are left out.
    """
    return _correlate(signals.join(forward, ["date", "symbol"]).filter("signal is not null and fwd is not null"), min_names)


def _correlate(both: DataFrame, min_names: int) -> DataFrame:
    key = ["alpha_id", "date"]
    ranked = both.select(*key, average_rank(F.col("signal"), key).alias("a"), average_rank(F.col("fwd"), key).alias("b"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    out = ranked.groupBy(*key).agg((F.covar_pop("a", "b") / F.when(spread != 0, spread)).alias("ic"), F.count(F.lit(1)).alias("n_names"))
    return out.filter((F.col("n_names") >= min_names) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame) -> DataFrame:
    """``alpha_id, ic_n_days, mean_rank_ic, ic_std, ic_information_ratio``; NULL below three days."""
    enough, sd = F.count("ic") >= 3, F.stddev_samp("ic")
    return ic.groupBy("alpha_id").agg(
        F.count("ic").alias("ic_n_days"), F.when(enough, F.avg("ic")).alias("mean_rank_ic"), F.when(enough, sd).alias("ic_std"), F.when(enough, F.avg("ic") / F.when(sd != 0, sd)).alias("ic_information_ratio")
    )


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties averaged; missing ones stay missing. One sort of a column."""
    seen = np.flatnonzero(~np.isnan(x))
    seen = seen[np.argsort(x[seen])]
    s, out = x[seen], np.full(len(x), np.nan)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
    sizes = np.diff(starts, append=len(s))
    out[seen] = np.repeat(starts + (sizes + 1) / 2, sizes)
    return out


def _date_ics(names: list[str], min_names: int, products: dict[str, tuple[str, ...]]):
    """Rank correlations of a date's cross-section, all signals at once: ranks within the names that have both values, ties averaged.

    Signals in ``products`` are made here, from the ranks of their series over all of the date's rows, as shares of their number.
    """

    def run(table: pa.Table) -> pa.Table:
        pick = lambda c: table[c].to_numpy(zero_copy_only=False).astype(float)  # noqa: E731  missing ones are NaN
        shares = {c: _ranks(x) / np.count_nonzero(~np.isnan(x)) for c, x in ((c, pick(c)) for c in {c for of in products.values() for c in of})}
        signal = lambda n: reduce(np.multiply, [shares[c] for c in products[n]]) if n in products else pick(n)
        fwd, x = pick("fwd"), np.column_stack([signal(n) for n in names])
        live = ~np.isnan(x) & ~np.isnan(fwd)[:, None]
        n = live.sum(0)
        each = lambda mask, of: _ranks(np.where(mask, of, np.nan))
        a = np.column_stack([each(live[:, j], x[:, j]) for j in range(len(names))])
        same: dict[bytes, int] = {}  # many signals have the same names: forward returns are ranked once for each such set
        first = [same.setdefault(live[:, j].tobytes(), j) for j in range(len(names))]
        ranked = {j: each(live[:, j], fwd) for j in same.values()}
        b = np.column_stack([ranked[j] for j in first])
        with np.errstate(invalid="ignore", divide="ignore"):
            middle = (n + 1) / 2.0  # the mean of average ranks
            a, b = np.where(live, a - middle, 0.0), np.where(live, b - middle, 0.0)
            spread = np.sqrt((a * a).sum(0) * (b * b).sum(0))
            ic = np.where(spread > 0, (a * b).sum(0) / spread, np.nan)
        keep = np.flatnonzero((n >= min_names) & ~np.isnan(ic))
        return pa.table({"alpha_id": pa.array([names[i] for i in keep], pa.string()), "date": pa.array([table["date"][0].as_py()] * len(keep), pa.date32()), "ic": pa.array(ic[keep], pa.float64()), "n_names": pa.array(n[keep], pa.int64())})

    return run


def rank_ic_wide(wide: DataFrame, names: list[str], min_names: int = 20, products: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``rank_ic`` of signals in a column each, with their forward return in column ``fwd`` of the same rows: no join.

    Rows go by date, once for all signals, not once for each; a task ranks a date's cross-section, as many rows as there are names.
    A signal in ``products`` has no column: it is the product of the ranks of the columns named there, over all rows of a date, also
    those without a forward return. So Spark neither sorts nor buffers the wide rows of a date once more for each rank.
    """
    products = products or {}
    needed = dict.fromkeys(c for n in names for c in products.get(n, (n,)))
    both = (wide if products else wide.filter("fwd is not null")).select("date", "fwd", *needed)
    return both.groupBy("date").applyInArrow(_date_ics(names, min_names, products), "alpha_id string, date date, ic double, n_names long")


def portfolio_returns(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """``alpha_id, date, ret``: sum of yesterday's signal (a symbol's row before) times today's return; 0 on days without any.

    Every date of the panel counts, the warm-up too.
    """
    lagged = F.lag("signal").over(Window.partitionBy("alpha_id", "symbol").orderBy("date"))
    held = signals.withColumn("weight", lagged).join(panel.select("date", "symbol", "returns"), ["date", "symbol"])
    return held.groupBy("alpha_id", "date").agg(F.coalesce(F.sum(F.col("weight") * F.col("returns")), F.lit(0.0)).alias("ret"))


def portfolio_returns_wide(wide: DataFrame, names: list[str]) -> DataFrame:
    """``portfolio_returns`` of signals in a column each, on a symbol's own rows with their ``returns``: summed by date before anything is unpivoted."""
    own = Window.partitionBy("symbol").orderBy("date")
    held = wide.select("date", *((F.lag(n).over(own) * F.col("returns")).alias(n) for n in names))
    daily = held.groupBy("date").agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    return daily.unpivot(["date"], names, "alpha_id", "ret").select("alpha_id", "date", "ret")


def performance(daily: DataFrame) -> DataFrame:
    """``alpha_id, annualized_return, annualized_vol, sharpe_ratio, n_days, daily_sharpe, skew, kurtosis`` (kurtosis not in excess)."""
    vol, mean = F.stddev_samp("ret"), F.avg("ret")
    own = F.coalesce(mean / F.when(vol != 0, vol), F.lit(0.0))
    spread = F.stddev_pop("ret") > 0
    return daily.groupBy("alpha_id").agg(
        (mean * DAYS).alias("annualized_return"), (vol * math.sqrt(DAYS)).alias("annualized_vol"), (own * math.sqrt(DAYS)).alias("sharpe_ratio"), F.count("ret").alias("n_days"), own.alias("daily_sharpe"),
        F.when(spread, F.skewness("ret")).alias("skew"), F.when(spread, F.kurtosis("ret") + 3).alias("kurtosis"),
    )


def expected_max_sharpe(trials: int, days: int) -> float:
    """Expected best daily Sharpe ratio among so many worthless trials; 0 for one."""
    if trials <= 1 or days < 1:
        return 0.0
    z = NormalDist().inv_cdf
    return ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e))) / math.sqrt(days)


def expected_max_sharpe_column(trials: DataFrame) -> DataFrame:
    """``trials`` (model, n_trials) with ``z_best``: the expectation times the square root of the days. A row for each model."""
    rows = [(r["model"], r["n_trials"], expected_max_sharpe(r["n_trials"], 1)) for r in trials.collect()]
    return trials.sparkSession.createDataFrame(rows, "model string, n_trials long, z_best double")


def trials_per_model(artifacts: DataFrame) -> DataFrame:
    """``model, n_trials``: artifacts of each model, failed ones too."""
    return artifacts.groupBy("model").agg(F.count(F.lit(1)).alias("n_trials"))


def dsr_z(sharpe: Column, best: Column, days: Column, skew: Column, kurtosis: Column) -> Column:
    """z-score of a daily Sharpe ratio against ``best``, with skewed, heavy-tailed returns; 0 where its error is 0."""
    under = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return F.when(under == 0, 0.0).otherwise((sharpe - best) * F.sqrt(days - 1) / F.sqrt(F.when(under > 0, under)))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Spark has no error function; this runs over one row for each signal."""
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(-x / math.sqrt(2)))


def screen(performances: DataFrame, trials: DataFrame, level: float = 0.95) -> DataFrame:
    """``performances`` (with model) and ``dsr_z_score, dsr, status``: survived above ``level``, else rejected."""
    best = F.broadcast(expected_max_sharpe_column(trials))
    z = dsr_z(F.col("daily_sharpe"), F.col("z_best") / F.sqrt(F.col("n_days")), F.col("n_days"), F.col("skew"), F.col("kurtosis"))
    out = performances.join(best, "model").withColumn("dsr_z_score", z)
    p = normal_cdf("dsr_z_score")
    out = out.withColumn("dsr", F.when(p < 0.0001, 0.0001).when(p > 0.9999, 0.9999).otherwise(p)).drop("z_best")
    return out.withColumn("status", F.when(F.col("dsr") > level, SURVIVED).otherwise(REJECTED))


def with_failures(screened: DataFrame, failures: DataFrame) -> DataFrame:
    """The screening table with a FAILED_EXECUTION row, and its message, for each of ``failures`` (alpha_id, model, theme, error).

    A signal that can't be computed is a row like any other; its figures are missing and it has no day of rank correlation.
    """
    lost = failures.withColumn("status", F.lit(FAILED))
    lost = lost.withColumn("ic_n_days", F.lit(0).cast("long")) if "ic_n_days" in screened.columns else lost
    return screened.unionByName(lost, allowMissingColumns=True)
