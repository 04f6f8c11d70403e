"""Long windows and histories: exponential means, sliding order statistics and blocks of time against pandas and plain windows."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspanel.operators import history, sliding
from crosspanel.operators.evaluate import _ranks
from crosspanel.plans.compiler import evaluate, evaluate_observed
from crosspanel.plans.expr import parse
from crosspanel.sources.panel import clean, densify, trade_panel

DAY0 = dt.date(1990, 1, 1)


def long_panel(spark, lengths, gaps=0.0, seed=3):
    draw = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(lengths):
        days = np.flatnonzero(draw.random(n + int(n * gaps) + 1) >= gaps)[:n]
        price = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, len(days))))
        for t, p in zip(days, price):
            o = p * (1 + draw.normal(0, 0.01))
            rows.append((DAY0 + dt.timedelta(int(t)), f"s{s}", o, max(o, p), min(o, p), p, float(draw.integers(0, 9))))
    frame = pd.DataFrame(rows, columns=["date", "symbol", "open", "high", "low", "close", "volume"])
    return clean(spark.createDataFrame(frame, "date date, symbol string, open double, high double, low double, close double, volume double")).cache()


def by_symbol(df, *columns):
    got = df.toPandas().sort_values(["symbol", "date"])
    return got[["symbol", "date", *columns]].reset_index(drop=True)


@pytest.mark.parametrize("span", [2, 3, 20, 252])
def test_exponential_means_against_pandas(spark, span):
    """5,000 rows a symbol, with stretches of missing values longer than the weights reach, beside a symbol that starts late and one without values."""
    base = long_panel(spark, [5000, 700, 40])
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    holes = base.withColumn("i", i).withColumn("x", F.when((F.col("symbol") == "s2") | ((F.col("symbol") == "s1") & (F.col("i") < 300)) | ((F.col("i") > 900) & (F.col("i") < 3600)) | (F.col("i") % 7 == 3) | ((F.col("i") > 4000) & (F.col("i") % 211 != 0)), None).otherwise(F.col("returns")))
    got = holes
    for name, recursive in (("a", False), ("r", True)):
        got = history.ewm_frame(got, F.col("x"), span, recursive, name)
    got = by_symbol(got, "x", "a", "r")
    for _, g in got.groupby("symbol"):
        for name, adjust in (("a", True), ("r", False)):
            want = g["x"].ewm(span=span, adjust=adjust).mean()
            np.testing.assert_allclose(g[name], want, rtol=1e-9, atol=1e-13)


def test_exponential_mean_needs_a_span(spark):
    with pytest.raises(ValueError):
        history.ewm_frame(long_panel(spark, [5]), F.col("close"), 1, False, "y")


@pytest.mark.parametrize("d", [1, 3, 500])
def test_sliding_order_statistics(d, monkeypatch):
    """Ties, missing values and infinities against a list for each window."""
    monkeypatch.setattr(sliding, "CELLS", 4096)
    draw = np.random.default_rng(d)
    x = draw.integers(0, 50, 2000).astype(float)
    x[draw.random(2000) < 0.002] = np.nan
    for name, want in {
        "ts_rank": lambda w: ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / d, "ts_median": np.median, "ts_argmax": lambda w: w.argmax() + 1, "ts_argmin": lambda w: w.argmin() + 1,
    }.items():
        kernel, _ = sliding.SLIDING[name]
        expected = [want(x[i - d + 1 : i + 1]) if i >= d - 1 and not np.isnan(x[i - d + 1 : i + 1]).any() else np.nan for i in range(len(x))]
        np.testing.assert_allclose(kernel(x, d), expected, rtol=1e-12, err_msg=name)
    few = sliding.SLIDING["median_min"][0](x, 7, 3)
    np.testing.assert_allclose(few, pd.Series(x).rolling(7, min_periods=3).median(), rtol=1e-12)
    y = np.array([1, np.inf, 2, -np.inf, np.inf])
    np.testing.assert_allclose(sliding.SLIDING["ts_argmax"][0](y, 3), [np.nan, np.nan, 2, 1, 3])


def test_ranks_in_short_windows_stay_in_spark(spark):
    """Ranks of up to five rows equal the sliding ones (ties, both zeros, missing values, infinities) without a pass through Python; longer ones slide."""
    draw = np.random.default_rng(7)
    values = [None if v == 5 else float("inf") if v == 6 else -0.0 if v == 7 else float(v) for v in draw.choice(8, 400, p=[0.2, 0.2, 0.2, 0.15, 0.15, 0.03, 0.03, 0.04])]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i % 200), f"s{i // 200}", v) for i, v in enumerate(values)]
    panel = spark.createDataFrame(rows, "date date, symbol string, close double").repartition(3)
    names = {f"r{d}": d for d in (1, 2, 3, 4, 5)}
    out = evaluate(panel, {k: parse(f"ts_rank(close, {d})") for k, d in names.items()})
    assert "FlatMapGroupsInArrow" not in _plan(out) and "FlatMapGroupsInArrow" in _plan(evaluate(panel, {"r": parse("ts_rank(close, 6)")}))
    got = by_symbol(out, *names)
    for s in (0, 1):
        x = np.array([np.nan if v is None or np.isinf(v) else v for v in values[200 * s : 200 * s + 200]])
        for k, d in names.items():
            np.testing.assert_array_equal(got[got["symbol"] == f"s{s}"][k].to_numpy(dtype=float), sliding.rank_of_last(x, d), err_msg=k)


def test_ranks_of_a_column_equal_those_of_pandas():
    """One sort a column: ties, infinities, both zeros and missing values, columns without any value too."""
    draw = np.random.default_rng(8)
    for n in (0, 1, 9, 500):
        for x in (draw.integers(0, 5, n).astype(float), draw.normal(size=n), np.full(n, np.nan)):
            x = np.where(draw.random(n) < 0.2, draw.choice([np.nan, np.inf, -np.inf, -0.0], n), x)
            np.testing.assert_array_equal(_ranks(x), pd.Series(x).rank().to_numpy())


FORMULAS = {
    "mean": "ts_mean(returns, 60)", "nested": "ts_sum(delta(ts_max(close, 9), 5), 20) / stddev(returns, 30)", "place": "ts_argmax(high, 11) - ts_rank(volume, 8)", "ahead": "lead(open, 3) / delay(ts_median(close, 5), 4)", "two": "correlation(ts_mean(close, 3), volume, 2)",
    "cross": "decay_linear(rank(ts_sum(volume, 7)), 6) + rank(correlation(close, volume, 10))", "corr": "correlation(open, volume, 12)", "least": "mean_min(returns, 40, 5) + median_min(volume, 6, 2)", "row": "close / open", "endless": "ewm(delay(returns, 2), 5) + cumcount(close)", "bare": "delay(cummax(close), 1)",
}


@pytest.mark.parametrize("rows", [16, 75, 4000])
def test_blocks_of_time_equal_plain_windows(spark, rows):
    panel = long_panel(spark, [900, 350, 61, 2], gaps=0.2)
    nodes = {k: parse(v) for k, v in FORMULAS.items()}
    plain, cut = (by_symbol(evaluate(panel, nodes, block_rows=b), *FORMULAS) for b in (None, rows))
    assert len(plain) == len(cut) == panel.count() > 1200
    pd.testing.assert_frame_equal(plain, cut, rtol=1e-12, atol=1e-12)


def test_one_symbol_is_many_tasks(spark):
    """A long history of one symbol meets all partitions, each block with no more rows around it than its windows reach."""
    panel = long_panel(spark, [6000])
    assert by_symbol(history.numbered(panel), history.ROW)[history.ROW].tolist() == list(range(1, 6001))
    spread = history.with_surroundings(history.numbered(panel), 100, 20, 3)
    sizes = [r["count"] for r in spread.groupBy(history.BLOCK).count().collect()]
    assert max(sizes) == 123 and len(sizes) >= 60
    out = evaluate(panel.repartition(4), {"v": parse("ts_mean(close, 20)")}, block_rows=100)

    assert re.search(r"Exchange hashpartitioning\(symbol#\d+, _block#\d+L?, \d+\)", out._jdf.queryExecution().executedPlan().toString())


def test_ranges_put_an_order_together(spark):
    """Numbers, running states and forward minima over ranges equal those of one window over everything."""
    from crosspanel.operators import decay, events, ranges

    draw = np.random.default_rng(6)
    at = sorted(set(draw.integers(0, 3000, 400).tolist()))
    days = [DAY0 + dt.timedelta(int(t)) for t in at]
    cal = [DAY0 + dt.timedelta(int(t)) for t in range(0, 2600) if t % 7 < 5 and not 1000 < t < 1300]
    frame = spark.createDataFrame([(d,) for d in cal], "date date").repartition(3)
    numbered = ranges.numbered_over(frame.withColumn("r", ranges.day_range("date")), "r", [F.col("date")], "n")
    assert [r["n"] for r in numbered.orderBy("date").collect()] == list(range(1, len(cal) + 1))
    calendar = spark.createDataFrame(list(zip(cal, range(len(cal)))), "date date, tpos int")
    jumps = spark.createDataFrame([(d, float(draw.normal()), float(draw.integers(0, 3))) for d in days], "date date, ret double, clarity double")
    placed = events.as_of(jumps, calendar)
    want = {d: next((i for i, c in enumerate(cal) if c >= d), -1) for d in days}
    assert {r["date"]: r["tpos"] for r in placed.collect()} == want
    got = sorted((r["date"], r["cluster"], r["episode_n_jumps"]) for r in events.decluster(placed, 9).collect())
    chain, last, rows = -1, None, []
    for d in days:
        if want[d] < 0:
            continue
        chain += last is None or want[d] - last > 9
        last = want[d]
        rows.append((chain, d))
    clarity = {r["date"]: (-r["clarity"], -abs(r["ret"]), r["date"]) for r in jumps.collect()}
    groups = {k: [d for c, d in rows if c == k] for k in {c for c, _ in rows}}
    assert got == sorted((min(g, key=clarity.get), k, len(g)) for k, g in groups.items()) and len(got) > 20
    x = draw.integers(0, 40, 300).astype(float)
    first = draw.random(300) < 0.4
    ks = decay.two_sample_ks(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, first)] + [(None, True)], "x double, first boolean")).first()["ks"]
    assert ks == pytest.approx(max(abs((x[first] <= v).mean() - (x[~first] <= v).mean()) for v in x))
    t = spark.createDataFrame([("treatment" if b else "control", 5, float(a)) for a, b in zip(x, first)], "arm string, b int, t double")
    assert decay.rank_sum(t).first()["u"] == sum((x[first][:, None] > x[~first]).ravel()) + 0.5 * sum((x[first][:, None] == x[~first]).ravel())


@pytest.mark.parametrize("size", [64, 3])
def test_correlations_by_blocks_against_pandas(spark, monkeypatch, size):
    from crosspanel.operators import decay

    monkeypatch.setattr(decay, "SIGNALS", size)
    monkeypatch.setattr(decay, "SPAN", 50)
    draw = np.random.default_rng(size)
    wide = pd.DataFrame(draw.normal(5, 0.01, (160, 11)), columns=[f"z{i}" for i in range(11)], index=[DAY0 + dt.timedelta(3 * i) for i in range(160)])
    wide = wide.mask(draw.random(wide.shape) < 0.3)
    wide["z3"] = 2.5  # doesn't vary
    wide["z4"] = wide["z5"] * 3 - 1
    wide.loc[wide.index[:80], "z6"] = np.nan
    wide.loc[wide.index[80:], "z7"] = np.nan  # no joint date with z6
    rows = [(n, d, None if np.isnan(v) else float(v)) for d, r in wide.iterrows() for n, v in r.items()]
    ic = spark.createDataFrame(rows, "alpha_id string, date date, ic double").repartition(3)
    got = {(r["a"], r["b"]): r["corr"] for r in decay.pairwise_correlations(ic).collect()}
    want = wide.corr(min_periods=2)
    names = sorted(wide.columns)
    pairs = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]} - {("z6", "z7")}
    assert set(got) == pairs
    for (a, b), c in got.items():
        assert (c is None) if "z3" in (a, b) else c == pytest.approx(want.loc[a, b], abs=1e-9)
    live = [c for c in got.values() if c is not None]
    assert tuple(decay.correlation_range(ic).first()) == pytest.approx((len(live), np.median(live), min(live), max(live)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_is_written_once_and_filled_without_joins(spark, tmp_path):
    """Lines are read for the panel alone; filling gaps moves rows by symbol once, which windows along time share."""
    draw = np.random.default_rng(2)
    rows = [(i, 1, i % 7, i % 5, dt.datetime(2000, 1, 3) + dt.timedelta(int(draw.integers(0, 200))), float(draw.integers(1, 9)), float(draw.integers(100, 999))) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    dense = densify(trade_panel(spark, str(tmp_path)))
    value = evaluate(dense, {"value": parse("ts_mean(log(close), 2)")})
    plan = _plan(value)
    assert "lineitem" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan)) == 1
    lines = pd.DataFrame(rows, columns=["o", "n", "p", "symbol", "at", "q", "x"])
    lines["date"] = lines["at"].dt.to_period("W").dt.start_time.dt.date
    lines["px"] = lines["x"] / lines["q"]
    close = lines.sort_values(["at", "o"]).groupby(["date", "symbol"])["px"].last().unstack()
    got = dense.toPandas().pivot(index="date", columns="symbol", values="close").astype(float)
    assert np.allclose(got.to_numpy(), close.to_numpy(), equal_nan=True)


def test_filled_gaps_of_odd_panels(spark):
    """Gaps are filled between first and last row only; repeated rows stay, rows without a symbol aren't observed."""
    day = lambda n: DAY0 + dt.timedelta(n)
    rows = [(day(0), "a", 1.0), (day(3), "a", 2.0), (day(1), "b", 3.0), (day(1), "b", 3.0), (day(2), "b", 4.0), (day(0), None, 5.0), (day(2), None, 6.0)]
    panel = spark.createDataFrame(rows, "date date, symbol string, close double").selectExpr("date", "symbol", "close open", "close high", "close low", "close", "close volume", "close returns")
    got = sorted((str(r["symbol"]), r["tpos"], r["date"], r["close"], r["observed"]) for r in densify(panel).collect())
    filled = [("None", t, day(t), None, False) for t in (0, 1, 2)] + [("a", 0, day(0), 1.0, True), ("a", 1, day(1), None, False), ("a", 2, day(2), None, False), ("a", 3, day(3), 2.0, True)]
    assert got == sorted(filled + [("b", 1, day(1), 3.0, True)] * 2 + [("b", 2, day(2), 4.0, True)], key=lambda r: r[:2])
    assert densify(panel.limit(0)).count() == 0


def test_observed_rows_travel_no_more_than_needed(spark, tmp_path):
    """Formulas on observed rows are those of the filled panel; ranks of prices need no filled rows and take no trip of their own."""
    rng = np.random.default_rng(4)
    rows = [(DAY0 + dt.timedelta(t), None if s == 8 else f"s{s}", *(None if (s + t + c) % 11 == 0 else float(rng.integers(1, 9)) for c in range(3)), float(rng.integers(1, 9)), 1.0) for s in range(9) for t in range(12) if (s * 5 + t) % 4]
    clean(spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double")).write.parquet(f"{tmp_path}/panel")
    panel = spark.read.parquet(f"{tmp_path}/panel")
    texts = {
        "a": "rank(close) * rank(delta(volume, 1))", "b": "ts_rank(rank(low), 2) - rank(low)", "c": "-1 * delta(close, 1)", "d": "rank(fill(open, 3))", "e": "xmean(returns) + rank(xcount(high))", "f": "rank(rank(open) - midrank(high))",
        "g": "demean(rank(close) - ts_sum(scale(volume, 2), 2))", "h": "close / open", "i": "rank(where(returns > 0, close, 2))", "j": "rank(mean_min(close, 3, 1))", "k": "least_names(zscore(returns), 3)",
    }
    formulas = {k: parse(v) for k, v in texts.items()}
    key = ["date", "symbol"]
    for part in (formulas, {k: formulas[k] for k in "fhk"}):
        got = evaluate_observed(panel, part, ("volume",)).toPandas().sort_values(key).reset_index(drop=True)
        want = evaluate(densify(panel), part, ("volume", "observed")).filter("observed").drop("observed").toPandas().sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    trips = lambda *names: _plan(evaluate_observed(panel, {k: formulas[k] for k in names})).count("Exchange hashpartitioning(symbol")
    assert trips("f", "h", "k") == 0
    assert trips("a", "b", "c", "f") == 1
