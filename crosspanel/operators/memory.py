"""Test 2: do signals do better in famous episodes than elsewhere?

Step 1 compares a signal's window mean with the controls' windows, step 2 its leave-window-out differential with placebo
windows, step 3 with matched low-salience episodes by permutation. Rank correlations are (alpha_id, date, ic).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import LEAST_DAYS, WINDOW, event_days
from .orders import BLOCK, orders, seed_of

CALIPER = 1.0
#: What the order of summation may leave between equal statistics: of gaps, and of slopes relative to their size.
EQUAL, EQUAL_SHARE = 1e-12, 1e-9


def on_calendar(ic: DataFrame, calendar: DataFrame) -> DataFrame:
    """``alpha_id, tpos, ic`` with a row for every signal and calendar date (signals are some hundred)."""
    ids = ic.select("alpha_id").distinct()
    grid = calendar.select("date", "tpos").crossJoin(F.broadcast(ids))  # calendar x signals: the size of the result
    return grid.join(ic.select("alpha_id", "date", "ic"), ["alpha_id", "date"], "left").select("alpha_id", "tpos", "ic")


def _ahead(width: int):
    return Window.partitionBy("alpha_id").orderBy("tpos").rowsBetween(0, width - 1)


def window_means(grid: DataFrame, width: int = WINDOW, least: int = LEAST_DAYS) -> DataFrame:
    """``alpha_id, start, mean``: mean over the window that starts at each position and fits the calendar."""
    w = _ahead(width)
    out = grid.withColumns({"n": F.count("ic").over(w), "rows": F.count(F.lit(1)).over(w), "mean": F.avg("ic").over(w)})
    return out.filter(F.col("rows") == width).select("alpha_id", F.col("tpos").alias("start"), F.when(F.col("n") >= least, F.col("mean")).alias("mean"))


def placebo_starts(calendar: DataFrame, events: DataFrame, width: int = WINDOW) -> DataFrame:
    """``start`` of the windows that overlap no event's window: positions within reach of an event are left out by equality."""
    blocked = events.filter("usable").select(F.explode(F.sequence(F.col("window_start") - (width - 1), F.col("window_start") + (width - 1))).alias("tpos")).distinct()
    last = calendar.agg(F.max("tpos").alias("last"))
    return calendar.join(blocked, "tpos", "left_anti").crossJoin(F.broadcast(last)).filter(F.col("tpos") + width - 1 <= F.col("last")).select(F.col("tpos").alias("start"))  # one row


def step1_thresholds(control_means: DataFrame, overall: DataFrame, q: float = 0.95) -> DataFrame:
    """``pooled, demeaned``: quantiles of the controls' window means, as they are and less each control's own mean. One row."""
    met = control_means.filter("mean is not null").join(F.broadcast(overall), "alpha_id")
    return met.agg(F.percentile("mean", F.lit(q)).alias("pooled"), F.percentile(F.col("mean") - F.col("own"), F.lit(q)).alias("demeaned"))


def overall_means(ic: DataFrame) -> DataFrame:
    return ic.groupBy("alpha_id").agg(F.avg("ic").alias("own"))


def bench(controls: DataFrame, least: int = 5) -> DataFrame:
    """``date, bench``: mean of the controls on dates that have at least ``least``."""
    return controls.groupBy("date").agg(F.when(F.count("ic") >= least, F.avg("ic")).alias("bench"))


def leave_window_out(grid: DataFrame, bench_grid: DataFrame, width: int = WINDOW, least: int = LEAST_DAYS) -> DataFrame:
    """``alpha_id, start, beta, d``: the window's mean of y - beta x, beta fitted to all joint days outside of the window.

    Sufficient statistics of the whole series less those of the window: one pass, no refit.
    """
    met = grid.join(F.broadcast(bench_grid), "tpos", "left")
    ok = F.col("ic").isNotNull() & F.col("bench").isNotNull()
    y, x = F.when(ok, F.col("ic")), F.when(ok, F.col("bench"))
    sums = {"n": F.when(ok, 1.0), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x}
    every, w = Window.partitionBy("alpha_id"), _ahead(width)
    zero = F.lit(0.0)
    out = met.withColumns({f"t_{k}": F.coalesce(F.sum(v).over(every), zero) for k, v in sums.items()} | {f"w_{k}": F.coalesce(F.sum(v).over(w), zero) for k, v in sums.items()} | {"rows": F.count(F.lit(1)).over(w)})
    r = {k: F.col(f"t_{k}") - F.col(f"w_{k}") for k in sums}
    spread = r["sxx"] - r["sx"] * r["sx"] / F.when(r["n"] > 0, r["n"])
    beta = F.when((r["n"] >= 2) & (spread > 1e-15), (r["sxy"] - r["sx"] * r["sy"] / F.when(r["n"] > 0, r["n"])) / F.when(spread > 1e-15, spread))
    out = out.filter(F.col("rows") == width).withColumn("beta", beta)
    d = F.when(F.col("w_n") >= least, (F.col("w_sy") - F.col("beta") * F.col("w_sx")) / F.when(F.col("w_n") > 0, F.col("w_n")))
    return out.select("alpha_id", F.col("tpos").alias("start"), "beta", d.alias("d"))


def step2_p(event_d: DataFrame, placebo: DataFrame) -> DataFrame:
    """``alpha_id, event_id, p2``: share of the placebo windows with at least the event's differential."""
    pool = placebo.filter("d is not null").select("alpha_id", F.col("d").alias("_d"))
    met = event_d.filter("d is not null").join(pool, "alpha_id")
    return met.groupBy("alpha_id", "event_id").agg(F.avg((F.col("_d") >= F.col("d")).cast("double")).alias("p2"))


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str], level: float = 0.05) -> DataFrame:
    """Adds ``<p>_q`` and ``<p>_reject``: step-up within each group; missing p-values are neither counted nor rejected."""
    some = F.col(p).isNotNull()
    order = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    up = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), "_rank").rowsBetween(0, Window.unboundedFollowing)
    ranked = rows.withColumns({"_rank": F.row_number().over(order), "_m": F.count(p).over(Window.partitionBy(*by))})
    raw = F.when(some, F.col(p) * F.col("_m") / F.col("_rank"))
    q = F.min(raw).over(up)
    out = ranked.withColumn(f"{p}_q", F.when(some, F.when(q > 1, 1.0).otherwise(q)))
    return out.withColumn(f"{p}_reject", F.coalesce(F.col(f"{p}_q") <= level, F.lit(False))).drop("_rank", "_m")


def precision(events: DataFrame, names: tuple[str, ...] = ("realized_vol", "drawdown", "dispersion")) -> np.ndarray | None:
    """Pseudo-inverse of the covariances over usable events with finite covariates; None below four of them. One row comes back."""
    ok = events.filter("usable").na.drop("any", subset=list(names))
    cells = [F.covar_samp(a, b).alias(f"{a}_{b}") for a in names for b in names]
    row = ok.agg(F.count(F.lit(1)).alias("n"), *cells).first()
    if row["n"] < 4:
        return None
    return np.linalg.pinv(np.array([[row[f"{a}_{b}"] for b in names] for a in names], float))


def matches(events: DataFrame, inverse: np.ndarray | None, caliper: float = CALIPER, names: tuple[str, ...] = ("realized_vol", "drawdown", "dispersion")) -> DataFrame:
    """``event_id, low_id, distance``: low-salience events within the caliper of each high one, by Mahalanobis distance.

    Arms have some ten events each; every high one is held against every low one. Without a geometry (None) nothing matches.
    """
    if inverse is None:
        return events.sparkSession.createDataFrame([], "event_id string, low_id string, distance double")
    ok = events.filter("usable").na.drop("any", subset=list(names))
    high = ok.filter("salience = 'high'").select("event_id", *names)
    low = F.broadcast(ok.filter("salience = 'low'").select(F.col("event_id").alias("low_id"), *(F.col(n).alias(f"_{n}") for n in names)))
    gap = [F.col(n) - F.col(f"_{n}") for n in names]
    square = sum((gap[i] * gap[j] * float(inverse[i, j]) for i in range(len(names)) for j in range(len(names))), F.lit(0.0))
    pairs = high.join(low, F.lit(True)).withColumn("distance", F.sqrt(F.when(square > 0, square).otherwise(0.0)))
    return pairs.filter(F.col("distance") <= caliper).select("event_id", "low_id", "distance")


def nearest(events: DataFrame, inverse: np.ndarray | None, names: tuple[str, ...] = ("realized_vol", "drawdown", "dispersion")) -> DataFrame:
    """``event_id, nearest``: distance of each high-salience event to the nearest low one, however far."""
    return matches(events, inverse, math.inf, names).groupBy("event_id").agg(F.min("distance").alias("nearest"))


def routes(event_d: DataFrame, gaps: DataFrame, near: DataFrame) -> DataFrame:
    """``alpha_id, event_id, scenario, n_matched_low, matched_low_ids, nearest``: B with matched low events, else A, where steps 1 and 2 decide alone."""
    met = event_d.filter("salience = 'high'").select("alpha_id", "event_id").join(gaps.select("alpha_id", "event_id", "n_low", "low_ids"), ["alpha_id", "event_id"], "left").join(F.broadcast(near), "event_id", "left")
    some = F.col("n_low").isNotNull()
    return met.select(
        "alpha_id", "event_id", F.when(some, "B").otherwise("A").alias("scenario"), F.coalesce("n_low", F.lit(0)).cast("long").alias("n_matched_low"),
        F.when(some, F.array_join("low_ids", "|")).otherwise("").alias("matched_low_ids"), "nearest",
    )


def composites(event_d: DataFrame, pairs: DataFrame) -> DataFrame:
    """``alpha_id, event_id, gap, n_low, low_ids``: an event's differential less the mean of its matched low events'."""
    low = event_d.filter("d is not null").select("alpha_id", F.col("event_id").alias("low_id"), F.col("d").alias("low_d"))
    met = event_d.filter("d is not null").join(F.broadcast(pairs), "event_id").join(low, ["alpha_id", "low_id"])
    out = met.groupBy("alpha_id", "event_id", "d").agg(F.avg("low_d").alias("composite"), F.count(F.lit(1)).alias("n_low"), F.array_sort(F.collect_set("low_id")).alias("low_ids"))
    return out.select("alpha_id", "event_id", (F.col("d") - F.col("composite")).alias("gap"), "n_low", "low_ids")


def day_differentials(ic: DataFrame, bench_days: DataFrame, events: DataFrame, calendar: DataFrame, lwo: DataFrame) -> DataFrame:
    """``alpha_id, event_id, tpos, d``: ic less the event's own beta times bench, on valid days of its window."""
    days = event_days(events, calendar)
    own = lwo.join(F.broadcast(events.filter("usable").select("event_id", F.col("window_start").alias("start"))), "start").select("alpha_id", "event_id", "beta")
    met = ic.join(F.broadcast(days), "date").join(bench_days, "date").join(own, ["alpha_id", "event_id"])
    return met.select("alpha_id", "event_id", "tpos", (F.col("ic") - F.col("beta") * F.col("bench")).alias("d")).filter("d is not null")


def _by_draws(groups: DataFrame, key: list[str], draws: int) -> DataFrame:
    """A row for each group and block of draws, spread over all tasks: ``first`` is the block's first draw, ``count`` its draws."""
    blocks = groups.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(BLOCK))))
    return blocks.withColumn("count", F.least(F.lit(BLOCK), F.lit(draws) - F.col("first"))).repartition(*key, "first")


def gap_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of the first slot less the mean of the other slots' means, along the last axis."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    means = np.stack([values[..., a:b].mean(axis=-1) for a, b in zip(edge, edge[1:])])
    return means[0] - means[1:].mean(axis=0)


def _gaps_drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            pool, sizes = np.asarray(r.pool, float), np.asarray(r.sizes)
            if len(sizes) < r.slots:  # a slot without a valid day
                continue
            own = float(gap_of(pool, sizes))
            null = gap_of(pool[orders(seed_of(r.alpha_id, r.event_id), r.first, r.count, len(pool))], sizes)
            out.append((r.alpha_id, r.event_id, own, null, int((null >= own - EQUAL).sum())))
        yield pd.DataFrame(out, columns=["alpha_id", "event_id", "observed", "nulls", "reached"])


def permutation_gaps(gaps: DataFrame, days: DataFrame, draws: int = 10_000) -> DataFrame:
    """``alpha_id, event_id, observed, p3, mdg``: gap of an event and its low events under permutations of their pooled days.

    ``mdg`` is the 95 % quantile of the null. Each draw's order follows from seed, signal, event and the draw's number, so results
    don't depend on how draws are spread over tasks; gaps that differ by what the order of summation leaves count as equal. A group
    has (1 + matches) windows of days, one row; its draws are made in blocks by many tasks. A group with a slot without days has no row.
    """
    key = ["alpha_id", "event_id"]
    slots = gaps.select(*key, (F.size("low_ids") + 1).alias("slots"), F.explode(F.concat(F.array("event_id"), "low_ids")).alias("slot"))
    pooled = slots.join(days.select("alpha_id", F.col("event_id").alias("slot"), "tpos", "d"), ["alpha_id", "slot"])
    ordered = F.array_sort(F.collect_list(F.struct((F.col("slot") != F.col("event_id")).alias("low"), "slot", "tpos", "d")))
    grouped = pooled.groupBy(*key, "slots").agg(ordered.alias("rows"))
    names = F.array_distinct(F.transform("rows", lambda r: r["slot"]))
    sizes = F.transform(names, lambda s: F.size(F.filter("rows", lambda r: r["slot"] == s)))
    # a group whose own event has no valid day starts with another slot
    whole = grouped.filter(F.col("rows")[0]["slot"] == F.col("event_id")).select(*key, "slots", F.transform("rows", lambda r: r["d"]).alias("pool"), sizes.alias("sizes"))
    drawn = _by_draws(whole, key, draws).mapInPandas(_gaps_drawn, "alpha_id string, event_id string, observed double, nulls array<double>, reached long")
    each = drawn.select(*key, "observed", "reached", F.posexplode("nulls").alias("i", "null"))
    return each.groupBy(*key).agg(F.first("observed").alias("observed"), (F.sum(F.when(F.col("i") == 0, F.col("reached"))) / draws).alias("p3"), F.percentile("null", F.lit(0.95)).alias("mdg"))


def residual_basis(columns: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span a constant and ``columns``; what others leave nothing of is left out."""
    basis: list[np.ndarray] = []
    for c in np.column_stack([np.ones(len(columns)), columns]).T:
        left = c.astype(float)
        for _ in range(2):  # the second time takes off what rounding left
            for b in basis:
                left = left - (left @ b) * b
        if left @ left > 1e-20 * max(c @ c, 1e-300):
            basis.append(left / np.sqrt(left @ left))
    return np.column_stack(basis)


def partial_slopes(y: np.ndarray, x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Slope of y on each row of x beside the basis: what the basis leaves of y times x over what it leaves of x, squared."""
    left = y - basis @ (basis.T @ y)
    spread = (x * x).sum(-1) - ((x @ basis) ** 2).sum(-1)
    return np.where(spread > 1e-12 * (x * x).sum(-1), x @ left / np.where(spread > 0, spread, 1.0), np.nan)


def _slopes_drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            y, nc, basis = np.asarray(r.d, float), np.asarray(r.consensus, float), residual_basis(np.column_stack([np.asarray(c, float) for c in (r.c0, r.c1, r.c2)]))
            nc = nc - nc.mean()
            own = float(partial_slopes(y, nc[None, :], basis)[0])
            null = partial_slopes(y, nc[orders(seed_of(r.alpha_id), r.first, r.count, len(nc))], basis)
            total = float(nc @ nc)
            r2 = 1 - (total - float(((nc @ basis) ** 2).sum())) / total if total > 0 else None
            out.append((r.alpha_id, None if np.isnan(own) else own, int((null >= own - EQUAL_SHARE * abs(own)).sum()), r2, r.first == 0))
        yield pd.DataFrame(out, columns=["alpha_id", "slope", "reached", "r2_severity", "is_first"])


def salience_gradient(event_d: DataFrame, events: DataFrame, draws: int = 1_000) -> DataFrame:
    """``alpha_id, slope, p, n_episodes, r2_severity``: slope of d on consensus beside volatility, drawdown and dispersion; p by permuting consensus.

    ``n_episodes`` are those with all values; below six the rest is missing. A slope is one dot product: y's residual on severity
    times consensus, over consensus' own residual; so no draw fits a regression. Severity without spread is left out.
    """
    names = ["realized_vol", "drawdown", "dispersion"]
    met = event_d.filter("d is not null").join(F.broadcast(events.filter("usable").select("event_id", "consensus", *names)), "event_id").na.drop("any")
    rows = F.array_sort(F.collect_list(F.struct("event_id", "d", "consensus", *names)))
    grouped = met.groupBy("alpha_id").agg(rows.alias("rows"), F.count(F.lit(1)).alias("n_episodes"))
    pick = lambda c: F.transform("rows", lambda r: r[c])
    enough = grouped.filter("n_episodes >= 6").select("alpha_id", pick("d").alias("d"), pick("consensus").alias("consensus"), *(pick(c).alias(f"c{i}") for i, c in enumerate(names)))
    drawn = _by_draws(enough, ["alpha_id"], draws).mapInPandas(_slopes_drawn, "alpha_id string, slope double, reached long, r2_severity double, is_first boolean")
    fitted = drawn.groupBy("alpha_id").agg(F.first("slope").alias("slope"), (F.sum("reached") / draws).alias("p"), F.first("r2_severity").alias("r2_severity"))
    out = grouped.select("alpha_id", "n_episodes").join(fitted, "alpha_id", "left")
    return out.select("alpha_id", "slope", F.when(F.col("slope").isNotNull(), F.col("p")).alias("p"), "n_episodes", "r2_severity")


def step1_flags(means: DataFrame, overall: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``means`` (alpha_id, mean, ...) with ``pooled_flag, demeaned_flag, disagree, step1``: strictly above either threshold."""
    met = means.join(F.broadcast(overall), "alpha_id").crossJoin(F.broadcast(thresholds))  # one row
    pooled, demeaned = F.coalesce(F.col("mean") > F.col("pooled"), F.lit(False)), F.coalesce(F.col("mean") - F.col("own") > F.col("demeaned"), F.lit(False))
    return met.select(*means.columns, pooled.alias("pooled_flag"), demeaned.alias("demeaned_flag"), (pooled != demeaned).alias("disagree"), (pooled | demeaned).alias("step1"))


def gap_over_mdg(gap: Column, mdg: Column) -> Column:
    """A gap in units of the least one that could be told from none; NULL without such a floor."""
    return gap / F.when(mdg > 0, mdg)


def event_verdicts(rows: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``binding``. Rows have d, step1, step2, step3 and has_placebo.

    INDETERMINATE without a differential or placebo; FAIL if steps 1 and 2 flag, or step 3 does; else PASS.
    """
    both, salient = F.col("step1") & F.col("step2"), F.col("step3")
    known = F.col("d").isNotNull() & F.col("has_placebo")
    verdict = F.when(~known, "INDETERMINATE").when(both | salient, "FAIL").otherwise("PASS")
    binding = F.when(~known, "insufficient_data").when(both & salient, "anomaly_and_salience_gap").when(salient, "salience_gap").when(both, "step1_anomaly_and_control_differential").otherwise("none")
    return rows.withColumns({"verdict": verdict, "binding": binding})


def synthesis(rows: DataFrame) -> DataFrame:
    """A row for each signal, counted over its events that have a verdict; INDETERMINATE if none has.

    Rows have alpha_id, verdict, binding, step1, step2, step3, mdg and gap_over_mdg. The modes are those of failed events.
    """
    known, failed = F.col("verdict") != "INDETERMINATE", F.col("verdict") == "FAIL"
    modes = F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("binding")))), ", ")
    out = rows.groupBy("alpha_id").agg(
        F.count_if(known).alias("events_tested"), F.count_if(failed).alias("events_failed"), F.count_if(known & F.col("step1")).alias("step1_anomaly_flags"),
        F.count_if(known & F.col("step2")).alias("step2_differential_flags"), F.count_if(known & F.col("step3")).alias("step3_salience_gap_flags"),
        F.percentile(F.when(known, F.col("mdg")), F.lit(0.5)).alias("step3_median_mdg"), F.max(F.when(known, F.col("gap_over_mdg"))).alias("step3_max_gap_over_mdg"), modes.alias("modes"),
    )
    verdict = F.when(F.col("events_tested") == 0, "INDETERMINATE").when(F.col("events_failed") > 0, "FAIL").otherwise("PASS")
    return out.withColumns({"verdict": verdict, "binding_failure_mode": F.when(F.col("events_failed") > 0, F.col("modes")).otherwise("none")}).drop("modes")


def report(rows: DataFrame) -> DataFrame:
    """``section, item, value``: the report's counts over all events that have a verdict, and the detection floor of scenario B."""
    ev = rows.filter("verdict <> 'INDETERMINATE'")
    power = ev.filter("scenario = 'B' and mdg is not null")
    value = lambda c: c.cast("double").alias("value")
    count = lambda c: F.count_if(c)
    totals = ev.agg(
        F.count(F.lit(1)).alias("tests"), count(F.col("scenario") == "A").alias("scenario_a"), count(F.col("scenario") == "B").alias("scenario_b"), count(F.col("disagree")).alias("step1_variants_disagree")
    )
    floor = power.agg(
        F.count(F.lit(1)).alias("tests"), F.percentile("mdg", F.lit(0.5)).alias("median"), F.min("mdg").alias("least"), F.max("mdg").alias("greatest"),
        F.max("gap_over_mdg").alias("greatest_ratio"), count(F.col("gap_over_mdg") >= 1).alias("reached"),
    )
    long = lambda df, name: df.select(*(F.col(c).cast("double").alias(c) for c in df.columns)).unpivot([], df.columns, "item", "value").select(F.lit(name).alias("section"), "item", "value")
    modes = ev.filter("verdict = 'FAIL'").groupBy("binding").agg(F.count(F.lit(1)).alias("n")).select(F.lit("binding").alias("section"), F.col("binding").alias("item"), value(F.col("n")))
    return long(totals, "results").unionByName(modes).unionByName(long(floor, "detection_floor"))


def power_by_event(rows: DataFrame, each: int = 3) -> DataFrame:
    """``event_id, matches, mdg, place``: the ``each`` least and most powered events of scenario B, by the median floor over signals."""
    power = rows.filter("verdict <> 'INDETERMINATE' and scenario = 'B' and mdg is not null")
    out = power.groupBy("event_id").agg(F.first("n_matched_low").alias("matches"), F.percentile("mdg", F.lit(0.5)).alias("mdg"))
    order = Window.orderBy(F.desc("mdg"), "event_id")  # some ten events
    placed = out.withColumns({"place": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    return placed.filter((F.col("place") <= each) | (F.col("place") > F.col("_n") - each)).drop("_n")


def history(grid: DataFrame, width: int = WINDOW, least: int = LEAST_DAYS) -> DataFrame:
    """``alpha_id, tpos, mean``: rolling means placed at the middle of their windows."""
    return window_means(grid, width, least).filter("mean is not null").select("alpha_id", (F.col("start") + width // 2).alias("tpos"), "mean")


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``bin, n``: counts in equally wide bins from the least to the greatest value, which is in the last bin."""
    edge = values.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    met = values.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(edge))  # one row
    width = F.col("_high") - F.col("_low")
    place = F.when(width > 0, F.floor((F.col(column) - F.col("_low")) / F.when(width > 0, width) * bins)).otherwise(0)
    return met.groupBy(F.when(place >= bins, bins - 1).otherwise(place).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
