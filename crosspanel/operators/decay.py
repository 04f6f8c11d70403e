"""Test 1: does a signal's edge over a control corpus decay after a cutoff, more than the controls' own does?

Rank correlations are long, (alpha_id, date, ic). A differential is a signal's value less its in-sample beta times the mean
of the controls (for a control: of the other controls). The drop of its mean from a baseline before the cutoff to after it,
over its standard error, is flagged against an order statistic of the controls' drops; flags over baseline lengths are votes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import handed, value_range

LENGTHS = (2, 3, 4, 5, 6, 7, 8)
REFERENCE_LENGTH = 5
FLOOR = 1e-14


def control_mean(controls: DataFrame, least: int = 1) -> DataFrame:
    """``date, bench``: mean over the controls alive on a date, if at least ``least`` are."""
    return controls.groupBy("date").agg(F.when(F.count("ic") >= least, F.avg("ic")).alias("bench")).filter("bench is not null")


def others_mean(controls: DataFrame) -> DataFrame:
    """``alpha_id, date, ic, bench``: each control with the mean of the *other* controls of the date."""
    day = Window.partitionBy("date")
    rest = F.count("ic").over(day) - F.when(F.col("ic").isNotNull(), 1).otherwise(0)
    total = F.sum("ic").over(day) - F.coalesce("ic", F.lit(0.0))
    return controls.select("alpha_id", "date", "ic", (total / F.when(rest > 0, rest)).alias("bench"))


def betas(benched: DataFrame, cutoff: str, least: int = 30) -> DataFrame:
    """``alpha_id, beta``: slope of ic on bench before the cutoff; 0 with ``least`` joint days or fewer, or without spread."""
    both = benched.filter(F.col("date") < F.lit(cutoff).cast("date")).filter("ic is not null and bench is not null")
    var = F.var_pop("bench")
    slope = F.when(F.count(F.lit(1)) > least, F.covar_pop("ic", "bench") / F.when(var != 0, var))
    return both.groupBy("alpha_id").agg(F.coalesce(slope, F.lit(0.0)).alias("beta"))


def differentials(benched: DataFrame, cutoff: str) -> DataFrame:
    """``alpha_id, date, d``: ic less beta times bench."""
    met = benched.join(F.broadcast(betas(benched, cutoff)), "alpha_id", "left")
    return met.select("alpha_id", "date", (F.col("ic") - F.coalesce("beta", F.lit(0.0)) * F.col("bench")).alias("d")).filter("d is not null")


def arms(ic: DataFrame, treated: list[str], controls: list[str], cutoff: str, end: str | None = None) -> DataFrame:
    """``arm, alpha_id, date, d`` for treatment and control on the dates that both arms have."""
    if end is not None:
        ic = ic.filter(F.col("date") <= F.lit(end).cast("date"))
    own, control = ic.filter(F.col("alpha_id").isin(treated)), ic.filter(F.col("alpha_id").isin(controls))
    shared = own.select("date").distinct().join(control.select("date").distinct(), "date", "left_semi")
    own, control = own.join(F.broadcast(shared), "date", "left_semi"), control.join(F.broadcast(shared), "date", "left_semi")
    t = differentials(own.join(F.broadcast(control_mean(control)), "date"), cutoff).withColumn("arm", F.lit("treatment"))
    c = differentials(others_mean(control).filter("bench is not null"), cutoff).withColumn("arm", F.lit("control"))
    return t.unionByName(c).select("arm", "alpha_id", "date", "d")


def mean_se(d: Column) -> Column:
    """Standard error of a mean from the population variance, which is at least ``FLOOR``; NULL below five days."""
    var = F.var_pop(d)
    return F.when(F.count(d) >= 5, F.sqrt(F.when(var > FLOOR, var).otherwise(FLOOR) / F.count(d)))


def decay_t(diff: DataFrame, cutoff: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``arm, alpha_id, b, base_mean, oos_mean, t``: the drop in units of its error, for baselines of b times the test period.

    The period L is the number of distinct dates from the cutoff on. A signal needs five of them and L dates before. All
    lengths are computed in one pass: a date's rank from the cutoff backwards says which baselines it is in.
    """
    edge = F.lit(cutoff).cast("date")
    length = diff.filter(F.col("date") >= edge).agg(F.countDistinct("date").alias("L"))
    marked = diff.crossJoin(F.broadcast(length)).withColumn("oos", F.col("date") >= edge)  # one row
    back = Window.partitionBy("arm", "alpha_id", "oos").orderBy(F.desc("date"))
    marked = marked.withColumn("back", F.row_number().over(back))
    key = ["arm", "alpha_id"]
    oos = marked.filter("oos").groupBy(*key).agg(F.avg("d").alias("oos_mean"), mean_se(F.col("d")).alias("oos_se"), F.count("d").alias("oos_n"))
    before = marked.filter("not oos").groupBy(*key).agg(F.count("d").alias("is_n"), F.first("L").alias("L"))
    spans = marked.filter("not oos").withColumn("b", F.explode(F.array(*map(F.lit, lengths)))).filter(F.col("back") <= F.col("b") * F.col("L"))
    base = spans.groupBy(*key, "b").agg(F.avg("d").alias("base_mean"), mean_se(F.col("d")).alias("base_se"))
    met = base.join(oos, key).join(before, key).filter("oos_n >= 5 and is_n >= L")
    error = F.sqrt(F.col("base_se") * F.col("base_se") + F.col("oos_se") * F.col("oos_se"))
    return met.select(*key, "b", "base_mean", "oos_mean", ((F.col("base_mean") - F.col("oos_mean")) / F.when(error > 0, error)).alias("t"))


def higher_quantile(values: Column, q: float) -> Column:
    """The order statistic at or above the quantile: sorted values at ceil(q (n - 1)). Some ten controls to some hundred."""
    rows = F.sort_array(F.collect_list(values))
    place = F.ceil(F.round(F.lit(q) * (F.size(rows) - 1), 9)).cast("int") + 1
    return F.when(F.size(rows) > 0, F.element_at(rows, place))


def critical(t: DataFrame, q: float = 0.95, least: int = 10) -> DataFrame:
    """``b, crit``: threshold from the controls; NULL with fewer than ``least`` of them."""
    return t.filter("arm = 'control'").groupBy("b").agg(F.when(F.count("t") >= least, higher_quantile(F.col("t"), q)).alias("crit"))


def others_critical(t: DataFrame, q: float = 0.95) -> DataFrame:
    """``alpha_id, b, t, crit``: each control against the threshold of the other controls."""
    c = t.filter("arm = 'control' and t is not null").select("alpha_id", "b", "t")
    o = c.select(F.col("alpha_id").alias("_other"), "b", F.col("t").alias("_t"))
    met = c.join(o, "b").filter("alpha_id <> _other")  # some hundred controls against each other
    return met.groupBy("alpha_id", "b", "t").agg(higher_quantile(F.col("_t"), q).alias("crit"))


def treatment_p(t: DataFrame) -> DataFrame:
    """``alpha_id, b, p``: (1 + controls with at least this t) / (1 + controls)."""
    c = t.filter("arm = 'control' and t is not null").select("b", F.col("t").alias("_t"))
    met = t.filter("arm = 'treatment' and t is not null").join(c, "b")
    return met.groupBy("alpha_id", "b").agg(((F.lit(1) + F.count_if(F.col("_t") >= F.col("t"))) / (F.lit(1) + F.count(F.lit(1)))).alias("p"))


def control_votes(t: DataFrame) -> DataFrame:
    return others_critical(t).groupBy("alpha_id").agg(F.count_if(F.col("t") > F.col("crit")).alias("votes"))


def treatment_votes(t: DataFrame) -> DataFrame:
    met = t.filter("arm = 'treatment'").join(F.broadcast(critical(t)), "b")
    return met.groupBy("alpha_id").agg(F.count_if(F.col("t") > F.col("crit")).alias("votes"))


def false_positive_curve(votes: DataFrame, most: int = len(LENGTHS)) -> DataFrame:
    """``k, fpr``: share of controls with at least k votes."""
    met = votes.withColumn("k", F.explode(F.array(*(F.lit(i).cast("long") for i in range(1, most + 1)))))
    return met.groupBy("k").agg(F.avg((F.col("votes") >= F.col("k")).cast("double")).alias("fpr"))


def least_votes(votes: DataFrame, level: float = 0.05, lengths: int = len(LENGTHS)) -> DataFrame:
    """``k_min``: the smallest k with a false positive rate of ``level`` at most, else a majority."""
    return false_positive_curve(votes, lengths).filter(F.col("fpr") <= level).agg(F.coalesce(F.min("k"), F.lit(lengths // 2 + 1)).alias("k_min"))


def verdicts(t: DataFrame) -> DataFrame:
    """``alpha_id, votes, verdict, base_mean, oos_mean``: FAILED from k_min votes on; the means are those of the reference length."""
    k = least_votes(control_votes(t))
    at = t.filter((F.col("arm") == "treatment") & (F.col("b") == REFERENCE_LENGTH)).select("alpha_id", "base_mean", "oos_mean")
    out = treatment_votes(t).join(at, "alpha_id", "left").crossJoin(F.broadcast(k))  # one row
    return out.select("alpha_id", "votes", F.when(F.col("votes") >= F.col("k_min"), "FAILED").otherwise("PASSED").alias("verdict"), "base_mean", "oos_mean")


def rank_sum(t: DataFrame, b: int = REFERENCE_LENGTH) -> DataFrame:
    """``n_treatment, n_control, u, z, p``: Mann-Whitney of treatment against control t-values, the alternative being greater.

    p is exact if an arm has eight or fewer and there are no ties, else normal with ties and continuity; z is the latter's.
    """
    pool = t.filter((F.col("b") == b) & F.col("t").isNotNull())
    # ranks within ranges of values, after the rows of lower ranges; equal values are in one range
    pool = handed(pool.withColumn("_range", value_range(pool, "t")), "_range", earlier={"_below_sum": F.count(F.lit(1))})
    low = F.coalesce("_below_sum", F.lit(0)) + F.rank().over(Window.partitionBy("_range").orderBy("t"))
    tied = F.count(F.lit(1)).over(Window.partitionBy("t"))
    ranked = pool.select("arm", (low + (tied - 1) / 2).alias("r"), tied.alias("tied"))
    own = F.col("arm") == "treatment"
    sums = ranked.agg(F.count_if(own).alias("m"), F.count_if(~own).alias("n"), F.sum(F.when(own, F.col("r"))).alias("s"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    u = F.col("s") - F.col("m") * (F.col("m") + 1) / 2
    total = F.col("m") + F.col("n")
    var = F.col("m") * F.col("n") / 12 * (total + 1 - F.col("ties") / (total * F.when(total > 1, total - 1)))
    z = (u - F.col("m") * F.col("n") / 2 - 0.5) / F.sqrt(F.when(var > 0, var))
    out = sums.select(F.col("m").alias("n_treatment"), F.col("n").alias("n_control"), u.alias("u"), z.alias("z"), "ties")
    return out.withColumn("p", rank_sum_p("u", "n_treatment", "n_control", "ties", "z")).drop("ties")


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    """One row goes in; Spark has neither the exact null distribution nor an error function."""

    def one(u: float, m: int, n: int, ties: float, z: float) -> float | None:
        if not m or not n or pd.isna(u):
            return None
        if min(m, n) <= 8 and not ties:
            return exact_rank_sum_p(u, m, n)
        return None if pd.isna(z) else 0.5 * math.erfc(z / math.sqrt(2))

    return pd.Series([one(*x) for x in zip(u, m, n, ties, z)], dtype=float)


def exact_rank_sum_p(u: float, m: int, n: int) -> float:
    """P(U >= u) without ties, by counting the ways to each rank sum of the smaller arm."""
    if n < m:
        return exact_rank_sum_p(u, n, m)  # both arms' statistics have one distribution
    counts = [[0] * (m * n + 1) for _ in range(m + 1)]
    counts[0][0] = 1
    for k in range(1, m + n + 1):
        for size in range(min(k, m), 0, -1):
            for s in range(m * n, -1, -1):
                back = s - (k - size)
                if 0 <= back and counts[size - 1][back]:
                    counts[size][s] += counts[size - 1][back]
    return sum(counts[m][math.ceil(u) :]) / math.comb(m + n, m)


def month_cutoff(month: str) -> str:
    """The first day after a month: a model that knows "2026-05" is tested from 2026-06-01 on."""
    year, number = map(int, month.split("-"))
    if not 1 <= number <= 12:
        raise ValueError(f"not a month: {month!r}")
    return f"{year + number // 12}-{number % 12 + 1:02d}-01"


def cutoff_of(model: str, cutoffs: dict[str, str]) -> str:
    """A model's cutoff from its last known month. There is no default: an unknown model is an error."""
    if model not in cutoffs:
        raise ValueError(f"no knowledge cutoff recorded for {model!r}")
    return month_cutoff(cutoffs[model])


def two_sample_ks(values: DataFrame) -> DataFrame:
    """``ks``: largest distance of the distribution functions of ``x`` where ``first`` and where not, counted over ranges of x."""
    rows = values.filter("x is not null")
    a, b = F.when(F.col("first"), 1), F.when(~F.col("first"), 1)
    rows = handed(rows.withColumn("_range", value_range(rows, "x")), "_range", earlier={"_a_sum": F.count(a), "_b_sum": F.count(b)})
    upto = Window.partitionBy("_range").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.select((F.coalesce("_a_sum", F.lit(0)) + F.count(a).over(upto)).alias("m"), (F.coalesce("_b_sum", F.lit(0)) + F.count(b).over(upto)).alias("n"))
    whole = rows.agg(F.max("m").alias("_m"), F.max("n").alias("_n"))  # one row
    return rows.crossJoin(F.broadcast(whole)).agg(F.max(F.abs(F.col("m") / F.when(F.col("_m") > 0, F.col("_m")) - F.col("n") / F.when(F.col("_n") > 0, F.col("_n")))).alias("ks"))


#: Signals of a block, and days of a block, in the products of ``pairwise_correlations``.
SIGNALS, SPAN = 64, 512


def _panel_of_block(table: pa.Table) -> pa.Table:
    """One block's values as a matrix of signals by days, missing ones as NaN."""
    names, row = np.unique(table["alpha_id"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    day = table["day"].to_numpy()
    x = np.full((len(names), SPAN), np.nan)
    x[row, day] = table["x"].to_numpy()
    return pa.table({"sb": table["sb"].slice(0, 1), "db": table["db"].slice(0, 1), "names": pa.array([names.tolist()], pa.list_(pa.string())), "x": pa.array([x.tobytes()], pa.binary())})


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Six sums over joint days for each pair of signals of two blocks, by matrix products."""
    for batch in batches:
        for r in batch.to_pylist():
            x, y = (np.frombuffer(r[k]).reshape(-1, SPAN) for k in ("x", "y"))
            a, b = ~np.isnan(x), ~np.isnan(y)
            x, y, p, q = np.where(a, x, 0.0), np.where(b, y, 0.0), a.astype(float), b.astype(float)
            sums = {"n": p @ q.T, "sx": x @ q.T, "sy": p @ y.T, "sxx": (x * x) @ q.T, "syy": p @ (y * y).T, "sxy": x @ y.T}
            left, right = np.array(r["anames"], object)[:, None], np.array(r["bnames"], object)[None, :]
            i, j = np.nonzero((left != right) & (sums["n"] > 0))
            swap = left[i, 0] > right[0, j]
            if r["asb"] == r["bsb"]:  # both orders of a pair are here
                i, j, swap = i[~swap], j[~swap], swap[~swap]
            one, two = np.where(swap, right[0, j], left[i, 0]), np.where(swap, left[i, 0], right[0, j])
            turned = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
            cells = {k: np.where(swap, sums[turned.get(k, k)][i, j], v[i, j]) for k, v in sums.items()}
            yield pa.RecordBatch.from_pydict({"a": pa.array(one, pa.string()), "b": pa.array(two, pa.string())} | {k: pa.array(v, pa.float64()) for k, v in cells.items()})


def pairwise_correlations(ic: DataFrame, value: str = "ic") -> DataFrame:
    """``a, b, corr`` for every pair of signals a < b on their joint dates; NULL where one doesn't vary there, no row without a joint date.

    Signals are dealt into blocks by a hash, dates into blocks of SPAN days; each pair of signal blocks meets once for each block of
    days, as matrices, and gives six sums for each pair of signals. So rows are shuffled by blocks, not by dates and pairs.
    Values are taken less their signal's mean, which leaves correlations as they are and sums small. The driver gets one count.
    """
    rows = ic.filter(F.col(value).isNotNull()).select("alpha_id", "date", F.col(value).alias("v"))
    blocks = max(1, -(-rows.select("alpha_id").distinct().count() // SIGNALS))
    centred = rows.join(rows.groupBy("alpha_id").agg(F.avg("v").alias("m")), "alpha_id")
    days = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    placed = centred.select("alpha_id", (F.col("v") - F.col("m")).alias("x"), F.pmod(F.xxhash64("alpha_id"), F.lit(blocks)).cast("int").alias("sb"), F.floor(days / SPAN).cast("int").alias("db"), F.pmod(days, F.lit(SPAN)).cast("int").alias("day"))
    panels = placed.groupBy("sb", "db").applyInArrow(_panel_of_block, "sb int, db int, names array<string>, x binary")
    left = panels.select("db", F.col("sb").alias("asb"), F.col("names").alias("anames"), "x", F.explode(F.sequence(F.col("sb"), F.lit(blocks - 1))).alias("bsb"))
    right = panels.select("db", F.col("sb").alias("bsb"), F.col("names").alias("bnames"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("sb"))).alias("asb"))
    met = left.join(right, ["db", "asb", "bsb"]).mapInArrow(_products, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = met.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    spread = lambda q, t: F.col("n") * F.col(q) - F.col(t) * F.col(t)
    varies = (spread("sxx", "sx") > 1e-12 * F.col("n") * F.col("sxx")) & (spread("syy", "sy") > 1e-12 * F.col("n") * F.col("syy"))
    below = F.sqrt(F.when(varies, spread("sxx", "sx") * spread("syy", "sy")))
    return s.select("a", "b", ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / below).alias("corr"))


def mean_pairwise_correlation(ic: DataFrame) -> DataFrame:
    """``n_pairs, mean_corr``: mean over pairs of signals of the correlation on joint dates."""
    return pairwise_correlations(ic).agg(F.count("corr").alias("n_pairs"), F.avg("corr").alias("mean_corr"))


def correlation_range(ic: DataFrame, value: str = "ic") -> DataFrame:
    """``n_pairs, median_corr, least_corr, greatest_corr`` over pairs of signals."""
    c = F.col("corr")
    return pairwise_correlations(ic, value).agg(F.count(c).alias("n_pairs"), F.percentile(c, F.lit(0.5)).alias("median_corr"), F.min(c).alias("least_corr"), F.max(c).alias("greatest_corr"))
