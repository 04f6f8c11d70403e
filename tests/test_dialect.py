"""Signals written in pandas: the graph read from the code against the code itself, run by pandas on a panel with gaps."""

import glob
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_engine import panel_of

from crosspanel.operators.artifacts import first_code_block
from crosspanel.operators.screening import code_signals, screening_table
from crosspanel.plans.artifact_catalogue import ARTIFACTS, artifact
from crosspanel.plans.compiler import evaluate
from crosspanel.plans.dialect import Refused, translate
from crosspanel.queries_artifacts import CODES, coded

HEAD = "import numpy as np\nimport pandas as pd\ndef generate_alpha(df, N=5, *, eps=1e-6):\n"
MORE = {
    "weighted": "    r = df['returns']\n    return r.groupby(level='symbol').transform(lambda x: x.ewm(span=N, min_periods=N).mean()) - r.groupby(level='symbol').transform(lambda x: x.ewm(span=3, adjust=False).mean())\n",
    "spreads": "    s = df['volume'].groupby(level='symbol', sort=False)\n    a = s.rolling(window=N).std(ddof=0).droplevel(0)\n    b = s.rolling(N, min_periods=2).std().reset_index(level=0, drop=True)\n    return (a / b).mask(b == 0, -1.0)\n",
    "true_range": "    p = df.groupby(level='symbol')['close'].shift(1)\n    t = pd.concat([df['high'] - df['low'], (df['high'] - p).abs(), (df['low'] - p).abs()], axis=1).max(axis=1, skipna=True)\n    ok = df[['open', 'close']].notna().all(axis=1)\n    return t.where(ok) / df['close']\n",
    "market": "    r = df['returns']\n    m = r.groupby(level='date').mean()\n    n = r.groupby(level='date').count()\n    m = m.where(n >= 3)\n    roll = m.rolling(window=N, min_periods=N).sum()\n    days = df.index.get_level_values('date')\n    return r - pd.Series(roll.reindex(days).to_numpy(), index=df.index)\n",
    "pairs": "    r = df['returns'].where(np.isfinite(df['returns']))\n    m = r.groupby(level='date').transform('mean')\n    ok = r.notna() & m.notna()\n    f = pd.DataFrame({'a': (r * m).where(ok), 'b': (m * m).where(ok)}, index=df.index)\n    s = f.groupby(level='symbol').rolling(window=N, min_periods=3).sum()\n    s.index = s.index.droplevel(0)\n    return s['a'].div(s['b'].where(s['b'] > 0.0))\n",
    "written": "    x = df.copy()\n    x.loc[:, ['close', 'volume']] = x[['close', 'volume']].where(np.isfinite(x[['close', 'volume']]))\n    x['up'] = np.maximum(x['close'] - x['open'], 0) ** 2\n    y = x['up'].groupby(level='symbol').rolling(N, min_periods=1).mean().droplevel(0)\n    y[(x['volume'] > 25) | x['returns'].isna()] = 0.5\n    return np.sqrt(y) if N > 2 else y\n",
    "ddof": "    v = np.log1p(df['volume'])\n    g = v.groupby(level='date')\n    z = (v - g.transform('mean')) / g.transform('std', ddof=0)\n    k = min(N, 3)\n    z += 0 * v\n    return -z.clip(-2, 2) * (k + np.sqrt(4.0)) + z.between(0, 1).astype(float).rsub(1)\n",
    "changes": "    c = df['close']\n    return c.groupby(level='symbol').pct_change(2).fillna(0.0) + df.groupby(level='symbol')['volume'].diff().gt(0) * 1.0 + (~(c > c.groupby(level='date').transform('mean'))) * 2.0\n",
    "counted": "    n = df['returns'].groupby(level='symbol').transform(lambda x: x.rolling(N, min_periods=2).count())\n    t = df['returns'].groupby(level='date').transform('sum')\n    return n.replace(2, np.nan) + t.rank(pct=True) * 0 if N < 0 else n.replace(2, np.nan) + t\n",
}


def run(code, panel):
    """The code as its author would run it."""
    names = {}
    exec(code, names)  # texts of this test and of the queries
    return names["generate_alpha"](panel)


@pytest.fixture(scope="module")
def panel(spark):
    return panel_of(spark, n_days=24, n_names=12, holes={(2, 7), (2, 8), (5, 0), (5, 1), (9, 20)}).cache()


@pytest.mark.parametrize("name", [*MORE, *(n for n in CODES if not n.startswith("refused"))])
def test_code_against_pandas(spark, panel, name):
    code = HEAD + MORE[name] if name in MORE else CODES[name].replace("2000-06-01", "2020-01-15").replace(">= 20", ">= 5")
    got = evaluate(panel, {"value": translate(code)}).toPandas().set_index(["date", "symbol"])["value"].astype(float).sort_index()
    frame = panel.toPandas().set_index(["date", "symbol"]).sort_index().astype(float)
    frame.index = frame.index.set_levels(pd.to_datetime(frame.index.levels[0]), level=0)
    want = run(code, frame).sort_index().astype(float)
    assert np.isfinite(want).sum() > 100
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(
    "body,why",
    [
        ("    for i in range(3): pass\n    return df['close']", "line 4: not known"), ("    return df['close'].apply(lambda x: x)", "method apply"), ("    return df['close'].rolling(3).sum()", "line 4"), ("    return df['close'].groupby(level='symbol').transform('mean')", "whole life"),
        ("    return df['close'] if df['close'] > 1 else df['open']", "condition on columns"), ("    return df['close'] ** 3", "power of 3"), ("    return os.listdir('/')", "unknown name"), ("    return open('/etc/passwd')", "unknown name"), ("    return eval('1')", "unknown name"),
        ("    return __import__('os')", "unknown name"), ("    return df.groupby('sector')['close'].mean()", "groups by"), ("    return 5", "no column"), ("    x = df['close']", "no column"), ("    return df['close'].groupby(level='symbol').rolling(5, min_periods=6).mean().droplevel(0)", "min_periods 6"),
        ("    return df['close'].groupby(level='symbol').rolling(5, min_periods=6).max().droplevel(0)", "min_periods 6"), ("    return df['nothing']", "no column"), ("    return (df['close'] & df['open'])", "conjunction"), ("    while True: pass", "not known"), ("    return df['close'].groupby(level='symbol').shift()(1)", "line 4"),
        ("    return df['close'].where()", "arguments"), ("    return df['close'].replace(1, 2)", "replacing by 2"), ("    return np.random.rand(3)", "line 4"),
        ("    return df['close'].groupby(level='symbol').rolling(5, center=True).mean().droplevel(0)", "option .'center'."), ("    return df['close'].groupby(level='symbol').shift(1, fill_value=0)", "option .'fill_value'."), ("    return df['close'].groupby(level='symbol').rolling(5, 2, True).mean()", "more than a window"),
        ("    return df['close'].groupby(level='symbol').transform(lambda x: x.ewm(alpha=0.3).mean())", "exponential window"), ("    return df['close'].groupby(level='symbol').transform(lambda x: x.ewm(span=5, ignore_na=True).mean())", "option"), ("    return df['close'].groupby(level='date').transform('sum', min_count=1)", "option"),
        ("    return df['close'].astype(int)", "cast to another"), ("    return df['close'].groupby(level='date').rank(method='first')", "ranks of another"), ("    return df['close'].fillna(method='ffill')", "option"),
    ],
)
def test_refusals_say_where_and_why(body, why):
    with pytest.raises(Refused, match=why):
        translate(HEAD + body + "\n")


def test_whole_codes_are_refused():
    for code, why in (("x = 1", "no function"), ("def generate_alpha(df:", "not Python"), ("def generate_alpha(): return 1", "no panel"), ("def generate_alpha(df, n): return df['close']", "no value"), ("def generate_alpha(df):\n    return " + "(" * 150 + "df['close']" + ")" * 150, "")):
        if why:
            with pytest.raises(Refused, match=why):
                translate(code)
    with pytest.raises(Refused, match="no parameter"):
        translate(CODES["calm_reversal"], other=1)
    assert translate(CODES["calm_reversal"], N=7) != translate(CODES["calm_reversal"])


def test_corpus_of_codes_is_screened(spark):
    panel = panel_of(spark, n_days=30)
    table = {r["alpha_id"]: r for r in screening_table(panel, code_signals(coded(spark)), min_names=5).collect()}
    assert len(table) == len(CODES) + 1 and {k for k, r in table.items() if r["error"]} == {k for k in CODES if k.startswith("refused")} | {"silent"}
    assert "N must be at least 2" in table["refused_itself"]["error"] and table["calm_reversal"]["mean_rank_ic"] is not None


@pytest.mark.skipif("CROSSPANEL_ARTIFACTS" not in os.environ, reason="a folder of stored artifacts")
def test_stored_artifacts_have_the_values_of_the_catalogue(spark):
    """Every stored artifact that has code translates, and to values that equal those of its formula in the catalogue."""
    panel = panel_of(spark, n_days=320, n_names=60).cache()
    codes = {}
    for path in glob.glob(os.environ["CROSSPANEL_ARTIFACTS"] + "/**/*.json", recursive=True):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        if stored["metadata"]["alpha_id"] in ARTIFACTS and stored["raw_response"]:
            codes[stored["metadata"]["alpha_id"]] = stored["raw_response"]
    rows = spark.createDataFrame(list(codes.items()), "id string, text string").select("id", first_code_block(F.col("text")).alias("code")).collect()
    nodes = {r["id"]: translate(r["code"], **({"min_obs": 60} if r["id"] == "alpha_a728eba6" else {})) for r in rows}
    assert len(nodes) == 47
    names = sorted(nodes)
    for at in range(0, len(names), 6):
        part = names[at : at + 6]
        mine = {f"{n}_x": nodes[n] for n in part} | {f"{n}_y": artifact(n, **({"min_obs": 60} if n == "alpha_a728eba6" else {})) for n in part}
        got = evaluate(panel, mine).toPandas()
        for n in part:
            a, b = got[f"{n}_x"].astype(float), got[f"{n}_y"].astype(float)
            assert b.notna().sum() > 1000, n
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12, err_msg=n)
