"""Formula language, null algebra, evaluation and statistics against small hand-made cases and pandas."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions.nulls import finite, greatest_or_null, ieee_div, least_or_null
from crosspanel.operators import artifacts as A
from crosspanel.operators import decay as D
from crosspanel.operators import evaluate as E
from crosspanel.operators import events as V
from crosspanel.operators import memory as M
from crosspanel.plans.artifact_catalogue import ARTIFACTS, artifact, artifacts
from crosspanel.plans.catalogue import BASES, CONTROLS, control, control_signal
from crosspanel.plans.compiler import evaluate, evaluate_observed, rank_products
from crosspanel.plans.expr import call, parse, schedule
from crosspanel.sources import tables
from crosspanel.sources.cache import kept
from crosspanel.sources.panel import clean, densify, read_panel

DAY0 = dt.date(2020, 1, 1)


def panel_of(spark, n_days=30, n_names=25, seed=1, holes=()):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_names):
        price = 100.0
        for t in range(n_days):
            price *= math.exp(rng.normal(0, 0.02))
            if (s, t) not in holes:
                o, c = price * (1 + rng.normal(0, 0.01)), price
                rows.append((DAY0 + dt.timedelta(t), f"s{s:02d}", o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rng.integers(1, 50))))
    return clean(spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double"))


def wide(df, column="value"):
    return df.toPandas().pivot(index="date", columns="symbol", values=column).astype(float)


def test_null_algebra(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (4.0, 2.0)], "a double, b double")
    out = rows.select(ieee_div(F.col("a"), F.col("b")).alias("q"), least_or_null(F.col("a"), F.col("b")).alias("l"), greatest_or_null(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r["q"] for r in out] == [math.inf, -math.inf, None, None, 2.0]
    assert out[3]["l"] is None and out[3]["g"] is None and out[4]["l"] == 2.0
    assert rows.select(finite(ieee_div(F.col("a"), F.col("b"))).alias("q")).filter("q is not null").count() == 1


def test_parser():
    assert parse("delay(close, 8.9)") == parse("delay(close, 8)")
    assert parse("rank(close) - rank(close)").args[0] is not None
    for bad in ("__import__('os')", "close.real", "nothing(close)", "delay(close)", "price"):
        with pytest.raises((ValueError, SyntaxError)):
            parse(bad)
    with pytest.raises(ValueError):
        parse("mean_min(close, 3, 4)")
    with pytest.raises(ValueError):
        control("k003", d_unknown=1)
    assert len(CONTROLS) == 50 and len(BASES) == 8


def test_schedule_alternates():
    steps = schedule([control_signal("k029")])
    assert [s.axis for s in steps if s.depth == 0] == ["time", "cross"] * (len({s.stage for s in steps}) // 2)
    assert max(s.stage for s in schedule([parse("rank(close)")])) == 1


def test_operators_match_pandas(spark):
    panel = panel_of(spark)
    names = {"a": "rank(close)", "b": "ts_rank(volume, 5)", "c": "correlation(open, volume, 6)", "d": "decay_linear(close, 4)", "e": "ts_argmax(high, 5)", "f": "stddev(close, 1)", "g": "ewm(close, 3)", "h": "ewm_rec(close, 3)"}
    got = evaluate(densify(panel), {k: parse(v) for k, v in names.items()}).toPandas()
    raw = {c: wide(panel, c) for c in ("open", "high", "close", "volume")}
    want = {
        "a": raw["close"].rank(axis=1, pct=True), "b": raw["volume"].rolling(5).apply(lambda x: x.rank(pct=True).iloc[-1]), "c": raw["open"].rolling(6).corr(raw["volume"]),
        "d": raw["close"].rolling(4).apply(lambda x: (x * [1, 2, 3, 4]).sum() / 10), "e": raw["high"].rolling(5).apply(lambda x: x.to_numpy().argmax() + 1), "f": raw["close"].rolling(1).std(),
        "g": raw["close"].ewm(span=3).mean(), "h": raw["close"].ewm(span=3, adjust=False).mean(),
    }
    for k, w in want.items():
        mine = got.pivot(index="date", columns="symbol", values=k).astype(float)
        np.testing.assert_allclose(mine.to_numpy(), w.to_numpy(), rtol=1e-7, atol=1e-9, equal_nan=True)


def test_axes_differ_at_a_gap(spark):
    panel = panel_of(spark, holes={(0, 5)})
    dense = evaluate(densify(panel), {"value": parse("delay(close, 1)")}).filter("symbol = 's00'").toPandas().set_index("date")["value"]
    sparse = evaluate(panel, {"value": parse("delay(close, 1)")}).filter("symbol = 's00'").toPandas().set_index("date")["value"]
    day = DAY0 + dt.timedelta(6)
    assert pd.isna(dense[day]) and not pd.isna(sparse[day])


def test_final_form_is_neutral(spark):
    out = wide(evaluate(densify(panel_of(spark)), {"value": control_signal("k101")}))
    assert np.allclose(out.sum(axis=1), 0) and np.allclose(out.abs().sum(axis=1), 1)
    thin = evaluate(densify(panel_of(spark, n_names=19)), {"value": control_signal("k101")})
    assert thin.filter("value is not null").count() == 0


def test_rank_ic_of_the_future_is_one(spark):
    panel = densify(panel_of(spark))
    fwd = E.forward_returns(panel)
    same = fwd.select(F.lit("x").alias("alpha_id"), "date", "symbol", F.col("fwd").alias("signal")).unionByName(fwd.select(F.lit("y").alias("alpha_id"), "date", "symbol", (-F.col("fwd")).alias("signal")))
    ic = {r["alpha_id"]: r["m"] for r in E.rank_ic(same, fwd).groupBy("alpha_id").agg(F.avg("ic").alias("m")).collect()}
    assert ic["x"] == pytest.approx(1) and ic["y"] == pytest.approx(-1)
    assert E.rank_ic(same.withColumn("signal", F.lit(1.0)), fwd).count() == 0
    with pytest.raises(ValueError):
        E.forward_returns(panel, "close_t9")


def test_deflated_sharpe():
    assert E.expected_max_sharpe(1, 100) == 0
    assert E.expected_max_sharpe(50, 100) > E.expected_max_sharpe(10, 100) > 0


def test_order_statistic_and_votes(spark):
    rng = np.random.default_rng(3)
    rows = [("control", f"c{i:02d}", b, 0.0, 0.0, float(rng.normal())) for i in range(50) for b in D.LENGTHS]
    t = spark.createDataFrame(rows, "arm string, alpha_id string, b int, base_mean double, oos_mean double, t double")
    flags = D.others_critical(t).filter("t > crit").groupBy("b").count().collect()
    assert {r["count"] for r in flags} == {3}  # 50 controls: exactly three each, whatever the data
    assert D.critical(t.filter("alpha_id < 'c05'")).filter("crit is not null").count() == 0
    assert D.least_votes(D.control_votes(t)).first()["k_min"] in range(1, 8)


def test_exact_rank_sum(spark):
    import itertools

    for m, n in ((3, 5), (9, 4), (2, 2)):  # against all ways to draw the ranks
        own = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        for u in (0, m * n // 2, m * n):
            assert D.exact_rank_sum_p(u, m, n) == pytest.approx(sum(x >= u for x in own) / len(own))
    pool = lambda a, b: spark.createDataFrame([("treatment", f"a{i}", 5, t) for i, t in enumerate(a)] + [("control", f"c{i}", 5, t) for i, t in enumerate(b)], "arm string, alpha_id string, b int, t double")
    assert D.rank_sum(pool([2.0, 3.0], [0.0, 1.0])).first()["p"] == pytest.approx(1 / 6)
    tied = D.rank_sum(pool([2.0, 3.0], [2.0, 1.0])).first()  # ties: normal with correction
    assert tied["p"] == pytest.approx(0.5 * math.erfc(tied["z"] / math.sqrt(2)))
    assert D.rank_sum(pool([], [1.0])).first()["p"] is None
    assert D.exact_rank_sum_p(4, 2, 2) == pytest.approx(1 / 6) and D.exact_rank_sum_p(0, 2, 2) == pytest.approx(1)


def test_decluster_and_as_of(spark):
    cal = spark.createDataFrame([(DAY0 + dt.timedelta(2 * i), i) for i in range(80)], "date date, tpos int")
    days = spark.createDataFrame([(DAY0 + dt.timedelta(d), 1.0, float(c)) for d, c in ((0, 1), (41, 2), (86, 5), (129, 5), (400, 9))], "date date, ret double, clarity double")
    at = V.as_of(days, cal)
    assert {r["date"]: r["tpos"] for r in at.collect()} == {DAY0: 0, DAY0 + dt.timedelta(41): 21, DAY0 + dt.timedelta(86): 43, DAY0 + dt.timedelta(129): 65, DAY0 + dt.timedelta(400): -1}
    found = V.decluster(at).orderBy("tpos").collect()
    assert [(r["tpos"], r["episode_n_jumps"]) for r in found] == [(21, 2), (43, 1), (65, 1)]


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", p) for p in (0.01, 0.02, 0.03, 0.5, None)], "g string, p double")
    out = sorted(((r["p"], r["p_q"], r["p_reject"]) for r in M.benjamini_hochberg(rows, "p", ["g"]).collect()), key=lambda x: (x[0] is None, x[0]))
    assert [x[2] for x in out] == [True, True, True, False, False]
    assert out[0][1] == pytest.approx(0.04) and out[3][1] == pytest.approx(0.5) and out[4][1] is None


def test_permutation_is_reproducible(spark):
    gaps = spark.createDataFrame([("a", "e1", ["e2"])], "alpha_id string, event_id string, low_ids array<string>")
    days = spark.createDataFrame([("a", e, t, float(v)) for e, v in (("e1", 1), ("e2", 0)) for t in range(10)], "alpha_id string, event_id string, tpos int, d double")
    one, two = M.permutation_gaps(gaps, days, 200).first(), M.permutation_gaps(gaps.repartition(3), days, 200).first()
    assert one == two and one["observed"] == 1 and one["p3"] < 0.05


def test_permutations_against_all_orders(spark):
    """p and the 95 % point of the null against every order of the pooled days of an event and its two low events."""
    windows = {"e1": [0.9, 0.1, 0.5], "e2": [0.3, -0.4], "e3": [0.2, 0.65]}
    gaps = spark.createDataFrame([("a", "e1", ["e2", "e3"])], "alpha_id string, event_id string, low_ids array<string>")
    days = spark.createDataFrame([("a", e, t, v) for e, x in windows.items() for t, v in enumerate(x)], "alpha_id string, event_id string, tpos int, d double")
    got = M.permutation_gaps(gaps, days).first()
    gap = lambda x: x[..., :3].mean(-1) - (x[..., 3:5].mean(-1) + x[..., 5:].mean(-1)) / 2
    pool = np.concatenate(list(windows.values()))
    null = gap(np.array(list(itertools.permutations(pool))))
    assert got["observed"] == pytest.approx(gap(pool)) and abs(got["p3"] - (null >= gap(pool) - 1e-12).mean()) < 0.02
    # the null has steps, so the quantile is held between its neighbours
    assert np.quantile(null, 0.94) <= got["mdg"] + 1e-12 and got["mdg"] - 1e-12 <= np.quantile(null, 0.96)


def test_salience_gradient_against_all_orders(spark):
    """Slope by the residuals of both sides, p against every order of consensus; five events are too few."""
    draw = np.random.default_rng(4)
    x, nc = draw.normal(size=(7, 3)), draw.normal(size=7)
    d = 0.4 * nc + x @ [0.2, -0.1, 0.3] + draw.normal(size=7) * 0.5
    rows = [(f"e{i}", True, *map(float, (nc[i], *x[i]))) for i in range(7)] + [("off", False, 9.0, 9.0, 9.0, 9.0), ("gap", True, 9.0, None, 9.0, 9.0)]
    events = spark.createDataFrame(rows, "event_id string, usable boolean, consensus double, realized_vol double, drawdown double, dispersion double")
    seen = [("a", f"e{i}", float(d[i])) for i in range(7)] + [("a", "off", 5.0), ("a", "gap", 5.0), ("a", "none", None)] + [("few", f"e{i}", 1.0) for i in range(5)]
    got = {r["alpha_id"]: r for r in M.salience_gradient(spark.createDataFrame(seen, "alpha_id string, event_id string, d double"), events).collect()}
    rest = np.column_stack([np.ones(7), x])
    left = np.eye(7) - rest @ np.linalg.inv(rest.T @ rest) @ rest.T
    slope = lambda v: (left @ v) @ d / ((left @ v) @ v)
    null = np.array([slope(np.array(v)) for v in itertools.permutations(nc)])
    assert got["a"]["slope"] == pytest.approx(slope(nc)) and abs(got["a"]["p"] - (null >= slope(nc) - 1e-12).mean()) < 0.06
    assert got["a"]["r2_severity"] == pytest.approx(1 - (left @ nc) @ nc / ((nc - nc.mean()) ** 2).sum())
    assert got["few"]["slope"] is None and got["few"]["p"] is None and got["few"]["n_episodes"] == 5 and got["a"]["n_episodes"] == 7


def test_correlation_of_two_days_against_pandas(spark):
    """The formula without an SQL twin: over two days a correlation is the product of the signs of both changes."""
    panel = panel_of(spark, n_days=34)
    got = wide(evaluate(densify(panel), {"value": control("k045")}))
    close, volume = wide(panel, "close"), wide(panel, "volume")
    two = lambda a, b: (np.sign(a.diff()) * np.sign(b.diff())).replace(0.0, np.nan)
    rank = lambda v: v.rank(axis=1, pct=True)
    total = lambda n: close.rolling(n).sum()
    want = -(rank(close.shift(5).rolling(20).mean()) * two(close, volume) * rank(two(total(5), total(20))))
    assert want.notna().sum().sum() > 100
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9, equal_nan=True)


def test_artifacts(spark):
    text = "Section 1\n```python\nx = 1\n```\nSection 2\n```\ndef generate_alpha(df, *, d=3):\n    return df.shift(-1)\n```\n"
    df = spark.createDataFrame([("a", text), ("b", None)], "alpha_id string, raw_response string")
    r = df.select(A.first_code_block(F.col("raw_response")).alias("f"), A.last_code_block(F.col("raw_response")).alias("l"), A.missing_sections(F.col("raw_response")).alias("m"))
    a, b = r.collect()
    assert a["f"] == "x = 1\n" and a["l"].startswith("def generate_alpha") and a["m"] == ["Section 3", "Section 4", "Section 5"] and b["l"] is None
    flags = r.select(A.code_flags("l").alias("c")).first()["c"]
    assert flags["parses"] and flags["defines"] and flags["keywords"] == ["d"] and flags["negative_shift"]
    assert A.manifest(df).first()["n_duplicates"] == 0
    with pytest.raises(ValueError):
        A.survivors(df, spark.createDataFrame([("z", "SURVIVED_PHASE_1")], "alpha_id string, status string"))


def test_first_block_is_the_whole_document(spark, tmp_path):
    """The query of first blocks gives each document's own hash, as its SQL does, with blank lines, fences or no language."""
    import hashlib

    import __spark_entry__

    texts = ["plain", "", "\n", "\n\n  first lines blank", " \t\nx", "a ``` b", "x\n```\ny", "```", "```python\nz\n```\n", "x\n\\```\n```\n\\\\```\n\\\ny\\", "x\n``````\n\n```", "$1 \\$1", "a\r\n\r\n```", None]
    rows = [(i, t, None if i % 2 else "en", "web") for i, t in enumerate(texts)] + [(100 + i, t, "en" if i % 2 else None, "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["block"] for r in __spark_entry__.queries()["code_block_first"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.sha256(f"{t}\n".encode()).hexdigest() for i, t, _, _ in rows}
    blocks = {"```python\n\n x\n```": "\n x\n", "```\na ``` b\n```": "a ``` b\n", "```python \nx\n```\n```python\ny\n```": "x\n", "```python\n```": None, None: None}
    found = spark.createDataFrame([(t,) for t in blocks], "t string").select("t", A.first_code_block(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in found} == blocks


def test_quotients_zeros_have_their_sign(spark, tmp_path):
    """An unchanged price over a thin volume's -1 is a negative zero, as in SQL, and so is a tiny fall rounded; infinities stay."""
    import __spark_entry__

    weeks = [(100.0, 5.0), (100.0, 5.0), (100.0, 30.0), (100.0 * (1 - 1e-8), 30.0), (100.0, 5.0), (100.0, 20.0), (101.0, 20.0), (50.0, 20.0), (75.0, 5.0)]  # price, quantity
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(weeks=i), i, 1, 1, p * q, q, 1) for i, (p, q) in enumerate(weeks)]
    names = "l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double, l_suppkey long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [str(r["value"]) for r in __spark_entry__.queries()["row_ieee_divide"](spark, str(tmp_path)).orderBy("date").collect()]
    assert got == ["None", "-0.0", "0.0", "-0.0", "-0.0", "None", "inf", "-inf", "-0.5"]


def test_entry_without_llm():
    """With the training-data operators gone, the engine's queries are still there."""
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['crosspanel.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert {'rank_ic_daily', 'alpha_k033'} <= set(q) and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _by_symbol(x, f):
    return x.groupby(level="symbol", group_keys=False).transform(f)


def test_artifacts_against_pandas(spark):
    """Signals of generated artifacts, one of each kind of statistic, against pandas written from their descriptions."""
    sparse = panel_of(spark, 80, 26, holes={(s, t) for s in range(0, 26, 3) for t in range(20, 80, 17)})
    names = ["alpha_8047543a", "alpha_cf45008b", "alpha_ac177fa4", "alpha_3205f951", "alpha_c76f01a4", "alpha_fc30ce60", "alpha_97aeb2d8", "alpha_b959ae38"]
    short = {"alpha_cf45008b": {"N_mom": 5, "N_vol": 10, "N_vol_volume": 6}, "alpha_ac177fa4": {"N_lookback": 20}, "alpha_3205f951": {"N_cs_min": 10}, "alpha_c76f01a4": {"N_beta": 20, "N_mkt": 10, "N_xs": 10}, "alpha_fc30ce60": {"N_beta": 30, "M_beta": 20}, "alpha_97aeb2d8": {"N_high": 20, "N_long_vol": 10}}
    got = evaluate(sparse, {n: artifact(n, **short.get(n, {})) for n in names}).toPandas().set_index(["date", "symbol"]).sort_index().astype(float)
    p = sparse.toPandas().set_index(["date", "symbol"]).sort_index()
    p = p.astype(float)
    o, h, lo, c, v, r = (p[k] for k in ("open", "high", "low", "close", "volume", "returns"))
    date = lambda x, f: x.groupby(level="date").transform(f)
    roll = lambda x, n, f, m=None: _by_symbol(x, lambda y: getattr(y.rolling(n, min_periods=m or n), f)())
    z = lambda x: (x - date(x, "mean")) / date(x, "std")
    centred = lambda x: 2 * (x.groupby(level="date").rank() - 1) / (date(x, "count") - 1) - 1
    want = {}
    share = lambda n: (roll(v.where(r > 0, 0.0), n, "sum") - roll(v.where(r < 0, 0.0), n, "sum")) / roll(v, n, "sum")
    want["alpha_8047543a"] = z(share(5) - share(21))
    smooth = _by_symbol(v / roll(v, 6, "mean"), lambda x: x.ewm(span=5, adjust=False).mean())
    want["alpha_cf45008b"] = z(_by_symbol(c, lambda x: x / x.shift(5) - 1) / (roll(r, 10, "std") * 5**0.5) * smooth)
    want["alpha_ac177fa4"] = _by_symbol(z(c / roll(h, 20, "max") * (v / roll(v, 20, "mean")).clip(upper=3)), lambda x: x.ewm(span=5, min_periods=5).mean())
    spread = _by_symbol(r, lambda x: x.rolling(20, min_periods=20).std(ddof=0))
    raw = -_by_symbol(c, lambda x: x / x.shift(3) - 1) / (spread * 3**0.5) * np.log(1 + v / roll(v, 20, "median"))
    want["alpha_3205f951"] = raw.groupby(level="date").rank(pct=True).where(date(raw, "count") >= 10) - 0.5
    m = date(r, "mean").where(date(r, "count") >= 10)
    x, y = r.where(m.notna()), m.where(r.notna())
    s = lambda a: roll(a, 20, "sum")
    b = (s(x * y) - s(x) * s(y) / 20) / (s(y * y) - s(y) ** 2 / 20)
    shock = m.groupby(level="date").first().rolling(5, min_periods=5).sum()
    e = b * pd.Series(shock.reindex(b.index.get_level_values("date")).to_numpy(), b.index)
    want["alpha_c76f01a4"] = (-centred(e)).where(date(e, "count") >= 10)
    m = date(r, "mean").where(date(r, "count") >= 2)
    x, y = r.where(m.notna()), m.where(r.notna())
    q = lambda a: roll(a, 30, "mean", 20)
    e = -(q(x * y) - q(x) * q(y)) / (q(y * y) - q(y) ** 2) * m
    want["alpha_fc30ce60"] = (e - date(e, "mean")) / e.groupby(level="date").transform("std", ddof=0)
    want["alpha_97aeb2d8"] = z(c / roll(h, 20, "max") * roll(v, 5, "mean") / roll(v, 10, "mean"))
    before = _by_symbol(c, lambda x: x.shift(1))
    tr = pd.concat([h - lo, (h - before).abs(), (lo - before).abs()], axis=1).max(axis=1)
    e = roll((c - o) / tr * (tr / roll(_by_symbol(tr, lambda x: x.shift(1)), 20, "mean") - 1.25).clip(lower=0), 3, "mean")
    rank = e.groupby(level="date").rank(pct=True)
    want["alpha_b959ae38"] = rank - date(rank, "mean")
    for n in names:
        assert want[n].notna().sum() > 300
        np.testing.assert_allclose(got[n].to_numpy(), want[n].reindex(got.index).to_numpy(), rtol=1e-4, atol=1e-6, err_msg=n)  # the signals add small numbers to what they divide by


def test_artifact_catalogue_isolates_failures():
    built, failed = artifacts()
    assert len(ARTIFACTS) == 48 and len(built) == 46 and "min_periods 126 must be <= window 60" in failed["alpha_a728eba6"] and "alpha_310a2d1a" in failed
    with pytest.raises(ValueError):
        artifact("alpha_0a22b5d9", N_none=1)


def test_covariance_of_small_series_keeps_its_order(spark):
    """Prices of a millionth don't turn covariances into ties."""
    small = panel_of(spark).withColumns({k: F.col(k) * 1e-7 for k in ("open", "close", "high", "low")}).withColumn("volume", F.col("volume") * 1e-7)
    got = wide(evaluate(small, {"value": parse("covariance(close, volume, 5)")})).to_numpy()
    live = got[~np.isnan(got)]
    assert len(np.unique(live)) > 0.99 * len(live)


def test_tables_round_trip(spark, tmp_path):
    ic = spark.createDataFrame([("Alpha_a", DAY0, 0.25), ("Alpha_b", DAY0, -0.5), ("Alpha_a", DAY0 + dt.timedelta(1), 0.125)], "alpha_id string, date date, ic double")
    tables.write_ic_csv(ic, f"{tmp_path}/ic")
    assert sorted(map(tuple, tables.read_ic_csv(spark, f"{tmp_path}/ic").collect())) == sorted(map(tuple, ic.collect()))
    (tmp_path / "odd.csv").write_text("date,x,y\n2020-01-01,1.5,\n2020-01-01,9,\n2020-01-02,oops,\nno date,3,\n")
    assert [tuple(r) for r in tables.read_ic_csv(spark, f"{tmp_path}/odd.csv", keep_first=True).collect()] == [("x", DAY0, 1.5)]
    assert tables.restrict(ic, spark.createDataFrame([("alpha_A",)], "alpha_id string")).count() == 2
    for ids in ([("nobody",)], []):
        with pytest.raises(ValueError):
            tables.restrict(ic, spark.createDataFrame(ids, "alpha_id string"))
    screened = spark.createDataFrame([("a", E.SURVIVED, 1.23456, None), ("b", E.REJECTED, 0.5, None), ("c", E.FAILED, None, 'said "no",\nthen ended')], "alpha_id string, status string, dsr double, error string")
    tables.write_table(screened, f"{tmp_path}/screened", ["alpha_id"], {"dsr": 4})
    assert [r["alpha_id"] for r in tables.read_survivors(spark, f"{tmp_path}/screened").collect()] == ["a"]
    back = spark.read.csv(f"{tmp_path}/screened", header=True, multiLine=True, escape='"').collect()
    assert [r["dsr"] for r in back] == ["1.2346", "0.5", None] and back[2]["error"] == 'said "no",\nthen ended'
    with pytest.raises(ValueError):
        tables.write_table(screened.filter("alpha_id = 'b'"), f"{tmp_path}/none")
        tables.read_survivors(spark, f"{tmp_path}/none")
    (tmp_path / "jumps.csv").write_text(" date , clarity,description\n2020-01-01,3,text\nnever,x,\n")
    assert [tuple(r) for r in tables.read_jumps(spark, f"{tmp_path}/jumps.csv").collect()] == [(DAY0, 3.0, "text"), (None, None, None)]
    (tmp_path / "parts.csv").write_text("symbol,market_cap,weight\nA,1,2\n")
    assert tables.read_constituents(spark, f"{tmp_path}/parts.csv").columns == ["symbol"]
    assert tables.first_existing("/nowhere", str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.first_existing("/nowhere")


def test_panel_and_artifact_files(spark, tmp_path):
    raw = spark.createDataFrame([(f"2020-01-0{d} 00:00:00", "A", 1.0, 2.0, 0.5, c, 10, "x") for d, c in ((1, 1.0), (2, 2.0), (3, float("nan")), (4, 3.0))], "date string, symbol string, open double, high double, low double, close double, volume long, other string")
    raw.withColumn("date", F.to_timestamp("date")).write.parquet(f"{tmp_path}/panel")
    got = read_panel(spark, f"{tmp_path}/panel").orderBy("date").collect()
    assert [(r["date"], r["returns"]) for r in got] == [(DAY0, None), (dt.date(2020, 1, 2), 1.0), (dt.date(2020, 1, 4), 0.5)] and "other" not in got[0]
    folder = tmp_path / "artifacts"
    folder.mkdir()
    (folder / "alpha_1.json").write_text('{"metadata": {"model": "m", "theme": "t", "generation_status": "success"},\n "raw_response": "Section 1 cap\\n```\\nx\\n```", "response_sha256": "s"}')
    (folder / "alpha_2.json").write_text('{"metadata": {"alpha_id": "own"}, "raw_response": null}')
    found = A.read_artifacts(spark, str(folder))
    flags = {r["alpha_id"]: r for r in A.validate(found).collect()}
    assert flags["alpha_1"]["code_block_found"] and flags["alpha_1"]["forbidden_data_tokens"] == [] and flags["own"]["code_block_found"] is None and flags["own"]["missing_sections"] is None
    A.copy_survivors(found, spark.createDataFrame([("own", E.SURVIVED), ("alpha_1", E.REJECTED)], "alpha_id string, status string"), f"{tmp_path}/kept")
    assert [r["alpha_id"] for r in spark.read.json(f"{tmp_path}/kept").collect()] == ["own"]


def test_descriptions_and_cutoffs(spark):
    rows = spark.createDataFrame([(DAY0, " longer text "), (DAY0, "short"), (DAY0, "NaN"), (DAY0, ""), (None, "x")], "date date, description string")
    assert [tuple(r) for r in V.descriptions(rows).collect()] == [(DAY0, "short")]
    assert D.month_cutoff("2026-05") == "2026-06-01" and D.month_cutoff("2025-12") == "2026-01-01"
    for bad in ("2026-13", "2026-00"):
        with pytest.raises(ValueError):
            D.month_cutoff(bad)
    with pytest.raises(ValueError):
        D.cutoff_of("unknown", {"known": "2026-01"})


def test_kept_tables_follow_their_source(spark, tmp_path, monkeypatch):
    """Fresh after a change anywhere below the source or of the plan; old versions and tables beyond the limit are gone."""
    import os

    from crosspanel.sources import cache

    cache.clear(spark)
    monkeypatch.setattr(cache, "folder", lambda _: str(tmp_path / "scratch"))
    left = lambda: len(os.listdir(tmp_path / "scratch"))
    source, runs = str(tmp_path / "source"), []

    def make(part="deep/t", more=0):
        runs.append(part)
        return spark.read.parquet(f"{source}/{part}").selectExpr(f"id + {more} as id")

    spark.range(3).write.parquet(f"{source}/deep/t")
    spark.range(2).write.parquet(f"{source}/other/u")
    assert cache.kept("t", spark, source, make).count() == 3 and cache.kept("t", spark, source, make).count() == 3 and left() == 1
    spark.range(4).write.mode("append").parquet(f"{source}/deep/t")  # a part file two levels down
    assert cache.kept("t", spark, source, make).count() == 7 and left() == 1
    assert cache.kept("t", spark, source, lambda: make(more=5)).agg({"id": "min"}).first()[0] == 5 and left() == 1
    assert cache.kept("u", spark, source, lambda: make("other/u")).count() == 2 and left() == 2
    monkeypatch.setattr(cache, "MOST", 3)
    for i in range(5):
        cache.kept(f"v{i}", spark, source, lambda: make("other/u"))
        assert cache.kept("u", spark, source, lambda: make("other/u")).count() == 2  # read again and again, so it stays
    assert left() == 3
    cache.clear(spark)
    assert left() == 0 and cache.stamp(spark, f"{source}/nothing") == ""


def test_call_errors():
    with pytest.raises(ValueError):
        call("rank", parse("close"), parse("open"))


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_queries_draw_as_often_as_the_operators(spark, monkeypatch):
    """The registered queries have p-values in steps of the operators' own numbers of draws."""
    from crosspanel import queries_memory as Q
    from crosspanel.queries import QUERIES

    low = [f"e{k}" for k in range(1, 4)]
    gaps = spark.createDataFrame([(a, "e0", low) for a in "abc"], "alpha_id string, event_id string, low_ids array<string>")
    rng = np.random.default_rng(3)
    days = spark.createDataFrame([(a, e, t, float(rng.normal())) for a in "abc" for e in ("e0", *low) for t in range(5)], "alpha_id string, event_id string, tpos int, d double")
    for name, value in (("days", None), ("ic_panel", days), ("bench_days", days.withColumn("bench", F.lit(1))), ("events", None), ("lwo", None), ("gaps", gaps)):
        monkeypatch.setattr(Q, name, lambda *_, v=value: v)
    monkeypatch.setattr(M, "day_differentials", lambda *_: days)
    p3 = [r["p3"] * 10_000 for r in Q.permuted(spark, "").collect()]
    assert all(abs(x - round(x)) < 1e-6 for x in p3) and any(round(x) % 10 for x in p3)

    ids = [f"e{k}" for k in range(12)]
    d = spark.createDataFrame([(a, e, "high", float(rng.normal())) for a in "abc" for e in ids], "alpha_id string, event_id string, salience string, d double")
    found = spark.createDataFrame([(e, True, *map(float, rng.normal(size=4))) for e in ids], "event_id string, usable boolean, consensus double, realized_vol double, drawdown double, dispersion double")
    monkeypatch.setattr(Q, "event_d", lambda *_: d)
    monkeypatch.setattr(Q, "events", lambda *_: found)
    p = [r["p"] * 1_000 for r in QUERIES["salience_gradient"](spark, "").collect()]
    assert all(abs(x - round(x)) < 1e-6 for x in p) and any(round(x) % 5 for x in p)


def test_validation_looks_into_the_code_alone(spark):
    """Tokens of the prose don't count, those of the last block do; the whole word is found between brackets and equals signs."""
    code = """import numpy as np
def generate_alpha(df, n=5, *, k=2):
    indclass = df['shares_outstanding'].fillna(0).replace(np.inf, cap)
    return df.shift(periods=-1)
"""
    texts = [
        ("code", f"no sector data, no clip\n```python\nold = vwap\n```\nSection 1\n```python\n{code}```\nindustry"), ("plain", f"rank\n```\nreturn capital_cap + (cap_a)\n```"), ("bare", "sector, cap"), ("one line", "```x```"),
        ("four", "a\n````\nb\n```"), ("wrong", "```py\ndef generate_alpha(:\n```"), ("second", "```\ndef generate_alpha(df, a, b): return df.shift(1, -2), shift(x, -1)\n```"), ("ahead", "```\ng = x.shift(2)\n```"), (None, None),
    ]
    got = {r["id"]: r for r in A.validate(spark.createDataFrame(texts, "id string, raw_response string")).collect()}
    r = got["code"]
    assert r["forbidden_data_tokens"] == ["indclass", "shares_outstanding", "cap"] and r["fidelity_watch_tokens"] == ["fillna", "replace", "np.inf"]
    assert r["keyword_args"] == ["n", "k"] and r["has_keyword_args"] and r["negative_shift_present"] and r["generate_alpha_defined"] and r["missing_sections"] == [f"Section {i}" for i in range(2, 6)]
    assert got["plain"]["forbidden_data_tokens"] == [] and not got["plain"]["code_parses"] is None
    for name in ("bare", "one line"):
        assert not got[name]["code_block_found"] and got[name]["forbidden_data_tokens"] == [] and got[name]["syntax_error"] is None
    assert got["four"]["code_block_found"] and got["wrong"]["syntax_error"] and not got["wrong"]["code_parses"]
    assert got["second"]["keyword_args"] == [] and got["second"]["negative_shift_present"] and not got["ahead"]["negative_shift_present"]
    assert got[None]["code_block_found"] is None and got[None]["forbidden_data_tokens"] is None
    blocks = {r["id"]: r["b"] for r in spark.createDataFrame(texts, "id string, t string").select("id", A.last_code_block(F.col("t")).alias("b")).collect()}
    assert blocks["four"] == "b\n" and blocks["code"] == code and blocks["one line"] is None


def test_status_of_empty_and_retrieved(spark):
    rows = [(True, "", False), (True, None, None), (True, " ", False), (None, "x", None), (True, "x", True), (True, "x", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "r boolean, t string, f boolean").select(A.generation_status(F.col("r"), F.col("t"), F.col("f"))).collect()]
    assert got == ["empty_response", "empty_response", "quarantined_retrieval_detected", "success", "api_error", "quarantined_retrieval_detected"]
    cut = spark.createDataFrame([("x" * 53 + "\t\u3000" + "y" * 9,), ("z" * 58,)], "t string").select(V.shorten(F.col("t"))).collect()
    assert [r[0] for r in cut] == ["x" * 53 + "...", "z" * 58]


def test_batch_isolates_failures_of_every_kind(spark):
    """Only culprits fail, whatever their number and place; the others' values are those of a batch without them."""
    import pandas as pd
    from pyspark.sql import functions as G

    from crosspanel.operators.screening import Batch, Signal, screening_table

    @G.pandas_udf("double")
    def broken(x: pd.Series) -> pd.Series:
        raise KeyError("no such level")

    panel = panel_of(spark)
    good = [Signal(f"g{i}", f"delta(close, {i + 1})", calendar=i % 2 == 0) for i in range(6)] + [Signal("col", lambda p: G.col("close") - 1), Signal("tab", lambda p: p.select("date", "symbol", G.col("volume").alias("signal")).filter("symbol < 's1'"))]
    bad = {
        "parse": "close +", "operator": "nothing(close)", "window": "mean_min(returns, 5, 9)", "column": lambda p: G.col("zzz"), "type": lambda p: G.array("close"), "kind": lambda p: 7, "raises": lambda p: 1 // 0,
        "overflow": lambda p: (G.dayofyear("date") + 1) * 2147483647, "udf": lambda p: broken("close"), "twice": lambda p: p.union(p).select("date", "symbol", G.col("close").alias("signal")),
    }
    mixed = [*good[:3], *(Signal(k, v) for k, v in bad.items()), *good[3:]]
    before = spark.conf.get("spark.sql.ansi.enabled")
    batch = Batch(panel, mixed)
    assert set(batch.failures) == set(bad) and all(batch.failures.values()) and spark.conf.get("spark.sql.ansi.enabled") == before
    assert batch.failures["overflow"].startswith("[ARITHMETIC_OVERFLOW]") and batch.failures["udf"].startswith("KeyError") and "two values" in batch.failures["twice"] and batch.failures["raises"].startswith("ZeroDivisionError")
    rows = lambda b: sorted((r["alpha_id"], r["date"], r["symbol"], r["signal"]) for r in b.signals.filter("signal is not null").collect())
    alone = Batch(panel, good)
    assert rows(batch) == rows(alone) and alone.runs == 1 and not alone.failures and 1 < batch.runs < 2 * len(mixed)
    table = {r["alpha_id"]: r for r in screening_table(panel, mixed, min_names=5).collect()}
    assert len(table) == len(mixed) and {k for k, r in table.items() if r["status"] == E.FAILED} == set(bad)
    assert table["udf"]["ic_n_days"] == 0 and table["udf"]["dsr"] is None and table["col"]["ic_execution"] == "open_t1" and table["g0"]["mean_rank_ic"] is not None
    assert screening_table(panel, [Signal("x", "close +")]).first()["status"] == E.FAILED
    with pytest.raises(ValueError):
        Batch(panel, [good[0], good[0]])
    with pytest.raises(ValueError):
        screening_table(panel, good, "never")


def test_orders_by_counters(monkeypatch):
    """The generator's published first numbers; every item is equally often in every place; blocks of draws are parts of one sequence."""
    from crosspanel.operators import orders as O

    assert [hex(x) for x in O.keys(0, 0, 1, 3)[0].tolist()] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4", "0x6c45d188009454f"]
    assert (O.keys(9, 0, 6, 5) == np.vstack([O.keys(9, 0, 2, 5), O.keys(9, 2, 4, 5)])).all()
    drawn = O.orders(O.seed_of("a", "e"), 0, 20_000, 5)
    for place in range(5):
        assert abs(np.bincount(drawn[:, place], minlength=5) / 20_000 - 0.2).max() < 0.012
    assert len({tuple(x) for x in drawn.tolist()}) == 120 and O.seed_of("a", "e") != O.seed_of("ae", "")


def test_permutations_do_not_depend_on_blocks(spark, monkeypatch):
    """Windows of unequal length and a group whose own event has no valid day; draws in one block or in many give the same."""
    draw = np.random.default_rng(8)
    sizes = {"e1": 4, "e2": 3, "e3": 5, "e9": 2}
    days = spark.createDataFrame([(a, e, t, float(draw.normal())) for a in "ab" for e, n in sizes.items() for t in range(n)], "alpha_id string, event_id string, tpos int, d double")
    gaps = spark.createDataFrame([("a", "e1", ["e2", "e3"]), ("b", "e9", ["e1"]), ("a", "e7", ["e1"]), ("b", "e3", ["e2", "e8"])], "alpha_id string, event_id string, low_ids array<string>")
    one = sorted(map(tuple, M.permutation_gaps(gaps, days, 1100).collect()))
    monkeypatch.setattr(M, "BLOCK", 7)
    many = sorted(map(tuple, M.permutation_gaps(gaps.repartition(2), days, 1100).collect()))
    assert [r[:2] for r in one] == [("a", "e1"), ("b", "e9")] and [r[:4] for r in one] == [r[:4] for r in many] and np.allclose([r[4] for r in one], [r[4] for r in many], atol=1e-12)


def test_partial_slopes_against_least_squares():
    """Each permuted slope is that of a whole regression, also where a severity has no spread or repeats another."""
    draw = np.random.default_rng(5)
    z = draw.normal(size=(30, 3))
    for columns in (z, np.column_stack([z[:, 0], np.full(30, 2.5), z[:, 2]]), np.column_stack([z[:, 0], 3 * z[:, 0] + 1, z[:, 2]])):
        y, x = draw.normal(size=30), draw.normal(size=(4, 30))
        got = M.partial_slopes(y, x - x.mean(1, keepdims=True), M.residual_basis(columns))
        want = [np.linalg.lstsq(np.column_stack([np.ones(30), v, columns]), y, rcond=None)[0][1] for v in x]
        np.testing.assert_allclose(got, want, rtol=1e-9)
    assert np.isnan(M.partial_slopes(y, (2 * z[:, :1]).T, M.residual_basis(z)))[0]


def test_rank_correlations_of_a_date_equal_the_long_form(spark):
    """Ties, missing values by signal, thin dates, a constant signal and one without values."""
    draw = np.random.default_rng(12)
    rows = []
    for t in range(12):
        for s in range(4 if t == 3 else 30):
            some = lambda x, p: None if draw.random() < p else float(x)
            rows.append((DAY0 + dt.timedelta(t), f"s{s}", some(draw.normal(), 0.2), float(draw.integers(0, 4)), some(draw.normal(), 0.4 if t % 2 else 0.0), 1.0, None))
    wide_rows = spark.createDataFrame(rows, "date date, symbol string, fwd double, a double, b double, c double, d double").repartition(3)
    names = ["a", "b", "c", "d"]
    long = E.rank_ic(E.long_signals(wide_rows, names), wide_rows.select("date", "symbol", "fwd"), 10)
    key = lambda df: {(r["alpha_id"], r["date"]): (pytest.approx(r["ic"], abs=1e-12), r["n_names"]) for r in df.collect()}
    got, want = key(E.rank_ic_wide(wide_rows, names, 10)), key(long)
    assert got.keys() == want.keys() and len(got) >= 20 and all(got[k][0] == want[k][0].expected and got[k][1] == want[k][1] for k in got)
    assert {k[0] for k in got} == {"a", "b"}


def test_few_events_have_no_matches(spark):
    """Fewer than four usable events give no geometry: nothing matches, no event is near another."""
    events = spark.createDataFrame([("e1", "high", True, 0.1, 0.2, 0.3), ("e2", "low", True, 0.2, 0.1, 0.3)], "event_id string, salience string, usable boolean, realized_vol double, drawdown double, dispersion double")
    assert M.precision(events) is None
    assert M.matches(events, M.precision(events)).count() == 0 and M.nearest(events, M.precision(events)).count() == 0


def test_batch_scores_columns_without_joins(spark):
    """Signals stay columns of one table: scores need no join with returns, a culprit's kind alone runs again, and odd names and missing symbols do no harm."""
    from crosspanel.operators.screening import Batch, Signal

    loose = panel_of(spark, n_days=12).limit(3).withColumn("symbol", F.lit(None).cast("string"))
    panel = panel_of(spark, n_days=12).unionByName(loose)
    bad = [Signal("over", lambda p: (F.dayofyear("date") + 1) * 2147483647), Signal("ahead", lambda p: F.col("_fwd"))]
    batch = Batch(panel, [Signal("fwd", "close / delay(close, 2)"), Signal("date", "rank(volume)"), Signal("own", "delta(close, 1)", calendar=False), Signal("col", lambda p: F.when(F.col("volume") > 9, F.col("close")).otherwise(F.lit(float("nan")))), *bad])
    assert set(batch.failures) == {"over", "ahead"} and len(batch.parts) == 3
    ic, daily = batch.rank_ic(5), batch.portfolio_returns()
    assert "Join" not in ic._jdf.queryExecution().executedPlan().toString() + daily._jdf.queryExecution().executedPlan().toString()
    signals = batch.signals.filter("signal is not null")
    rows = lambda df, value: {(r["alpha_id"], r["date"]): r[value] for r in df.collect()}
    assert rows(ic, "ic") == pytest.approx(rows(E.rank_ic(signals, E.forward_returns(densify(panel)), 5), "ic"), abs=1e-9)
    assert rows(daily, "ret") == pytest.approx(rows(E.portfolio_returns(batch.signals, panel), "ret"), abs=1e-9)


def test_last_ranks_are_taken_with_the_correlations(spark):
    """Products of a date's ranks need no window over its wide rows; ties, rows without a forward return, gaps and missing symbols give what windows give."""
    loose = panel_of(spark, n_days=14).limit(3).withColumn("symbol", F.lit(None).cast("string"))
    panel = panel_of(spark, n_days=14, holes={(0, 3), (1, 4), (1, 5), (2, 13)}).unionByName(loose)
    texts = {"a": "rank(-1 * (1 - open / close))", "b": "rank(volume)", "c": "rank(returns) * rank(volume)", "d": "rank(close) * rank(volume) * rank(low)", "e": "delta(close, 1)", "f": "-1 * ts_rank(rank(low), 3)", "g": "rank(delta(close, 1))", "h": "rank(close) * (rank(low) * rank(volume))"}
    formulas = {k: parse(v) for k, v in texts.items()}
    ahead = {"fwd": parse("isfinite(lead(open, 2) / lead(open, 1) - 1)")}
    columns, products = rank_products(formulas)
    assert set(products) == set("abcd") and len(products["d"]) == 3 and set("efgh") <= set(columns)
    rows = lambda df: sorted((r["alpha_id"], r["date"], r["ic"], r["n_names"]) for r in df.collect())
    got = rows(E.rank_ic_wide(evaluate_observed(panel, columns | ahead, by="date"), list(formulas), 10, products))
    want = rows(E.rank_ic_wide(evaluate_observed(panel, formulas | ahead), list(formulas), 10))
    assert len(got) > 80 and got == want
    plain = {k: formulas[k] for k in "abce"}
    columns, products = rank_products(plain)
    windows = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Window [")
    after = windows(E.rank_ic_wide(evaluate_observed(panel, columns | ahead, by="date"), list(plain), 10, products))
    assert after == windows(evaluate_observed(panel, columns | ahead)) < windows(E.rank_ic_wide(evaluate_observed(panel, plain | ahead), list(plain), 10))
