"""Queries of test 2, with their twins where SQL can say them. The test tables are weekly, so windows are five weeks long."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import events as V
from .operators import memory as M
from .operators.orders import keys_sql, seed_sql
from .queries import register, rounded
from .queries_eval import _PRELUDE, ic_panel
from .sources.cache import folder, kept
from .sources.panel import calendar, trade_panel
from .sources.sheets import write_sheet
from .sources.tables import read_jumps

WIDTH, GAP, LEAST = 5, 2, 4
FIRST, LAST = "1995-02-01", "2001-10-01"


def _kept(name: str, spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return kept(name, spark, sf_dir, lambda: make(spark, sf_dir))


def raw_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week is a jump if its number of orders is a multiple of five; clarity and confidence are remainders of that number."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.count(F.lit(1))
    weeks = orders.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")).agg(
        n.alias("n"), *((F.count_if(F.col("o_orderstatus") == c) / n).alias(f"share_{c.lower()}") for c in "OFP")
    )
    weeks = weeks.filter("n % 5 = 0").withColumns({"clarity": (F.col("n") % 11).cast("double"), "confidence": (1 + F.col("n") % 3).cast("double")})
    return weeks.join(V.market(trade_panel(spark, sf_dir)).select("date", F.col("mkt_ret").alias("ret")), "date", "left")


def _jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jumps(raw_jumps(spark, sf_dir), ["share_o", "share_f", "share_p"], FIRST, LAST, {"share_o": "open"})


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept("days", spark, sf_dir, lambda s, d: calendar(trade_panel(s, d)))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept("market", spark, sf_dir, lambda s, d: V.market(trade_panel(s, d)))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept("mapped", spark, sf_dir, lambda s, d: V.as_of(_jumps(s, d), days(s, d)))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One jump for each episode: later steps read this small table more than once."""
    return _kept("anchors", spark, sf_dir, lambda s, d: V.decluster(mapped(s, d), GAP))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(s: SparkSession, d: str) -> DataFrame:
        cal = days(s, d)
        placed = V.windows(V.salience(anchors(s, d)), cal.count(), WIDTH)
        return placed.join(V.window_covariates(placed, cal, market(s, d), LEAST), "event_id", "left")

    return _kept("events", spark, sf_dir, make)


def grid(spark: SparkSession, sf_dir: str, controls: bool | None = None) -> DataFrame:
    ic = ic_panel(spark, sf_dir)
    if controls is not None:
        ic = ic.filter("alpha_id like 'c%'" if controls else "alpha_id like 'a%'")
    return M.on_calendar(ic, days(spark, sf_dir))


def bench_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bench(ic_panel(spark, sf_dir).filter("alpha_id like 'c%'"))


def lwo(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = days(spark, sf_dir).join(bench_days(spark, sf_dir), "date", "left").select("tpos", "bench")
    return _kept("lwo", spark, sf_dir, lambda s, d: M.leave_window_out(grid(s, d, controls=False), bench, WIDTH, LEAST))


def event_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = events(spark, sf_dir).filter("usable").select("event_id", "salience", F.col("window_start").alias("start"))
    return lwo(spark, sf_dir).join(F.broadcast(usable), "start").select("alpha_id", "event_id", "salience", "d")


def placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = M.placebo_starts(days(spark, sf_dir), events(spark, sf_dir), WIDTH)
    return lwo(spark, sf_dir).join(F.broadcast(starts), "start").select("alpha_id", "start", "d")


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.step1_thresholds(M.window_means(grid(spark, sf_dir, controls=True), WIDTH, LEAST), M.overall_means(ic_panel(spark, sf_dir)))


def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = event_d(spark, sf_dir).filter("salience = 'high'")
    return high.join(M.step2_p(high, placebo(spark, sf_dir)), ["alpha_id", "event_id"], "left")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir)
    return M.matches(found, M.precision(found), 2.0)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.composites(event_d(spark, sf_dir), pairs(spark, sf_dir))


def permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = days(spark, sf_dir)
    daily = M.day_differentials(ic_panel(spark, sf_dir).filter("alpha_id like 'a%'"), bench_days(spark, sf_dir).filter("bench is not null"), events(spark, sf_dir), cal, lwo(spark, sf_dir))
    return M.permutation_gaps(gaps(spark, sf_dir), daily)


def step1(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = M.window_means(grid(spark, sf_dir, controls=False), WIDTH, LEAST)
    usable = events(spark, sf_dir).filter("usable").select("event_id", F.col("window_start").alias("start"))
    met = means.join(F.broadcast(usable), "start").select("alpha_id", "event_id", "mean")
    return M.step1_flags(met, M.overall_means(ic_panel(spark, sf_dir)), thresholds(spark, sf_dir))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir)
    return M.routes(event_d(spark, sf_dir), gaps(spark, sf_dir), M.nearest(found, M.precision(found)))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(s: SparkSession, d: str) -> DataFrame:
        key = ["alpha_id", "event_id"]
        rows = p2(s, d).join(step1(s, d).drop("mean"), key, "left").join(permuted(s, d), key, "left").join(routes(s, d), key, "left")
        rows = M.benjamini_hochberg(M.benjamini_hochberg(rows, "p2", ["alpha_id"]), "p3", ["alpha_id"])
        rows = rows.withColumns({
            "step2": F.col("p2_reject") & (F.col("d") > 0), "step3": F.coalesce(F.col("p3_reject") & (F.col("observed") > 0), F.lit(False)), "has_placebo": F.col("p2").isNotNull(),
            "step1": F.coalesce("step1", F.lit(False)), "disagree": F.coalesce("disagree", F.lit(False)), "gap_over_mdg": M.gap_over_mdg(F.col("observed"), F.col("mdg")),
        })
        kept_columns = ["d", "p2", "p2_q", "p3", "p3_q", "observed", "mdg", "gap_over_mdg", "scenario", "n_matched_low", "matched_low_ids", "nearest", "step1", "disagree", "step2", "step3", "verdict", "binding"]
        return M.event_verdicts(rows).select(*key, *kept_columns)

    return _kept("verdicts", spark, sf_dir, make)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows dealt from the orders: signals with failed, passed and no usable events, whose steps must not count, and one without any."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    signal = F.col("o_custkey") % 40
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (key % n + 1).cast("int"))
    verdict = F.when(signal == 7, "INDETERMINATE").when(signal == 8, "PASS").otherwise(pick(7, "FAIL", "PASS", "PASS", "INDETERMINATE", "PASS", "PASS", "FAIL"))
    odd = lambda n: key % n == 0
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("s"), signal).alias("alpha_id"), F.concat(F.lit("e"), key % 23).alias("event_id"), verdict.alias("verdict"), pick(3, "salience_gap", "anomaly_and_salience_gap", "step1_anomaly_and_control_differential").alias("binding"),
        odd(2).alias("step1"), odd(3).alias("step2"), odd(5).alias("step3"), F.when(~odd(4), F.floor(price) / 1000).alias("mdg"), F.when(~odd(6), F.floor(price / 50000)).cast("double").alias("gap_over_mdg"),
        F.when(odd(3), "A").otherwise("B").alias("scenario"), (key % 23 % 5).alias("n_matched_low"), odd(11).alias("disagree"),
    )


_DEALT = """WITH dealt AS (
SELECT 's' || (o_custkey % 40) AS alpha_id, 'e' || (o_orderkey % 23) AS event_id, CASE o_custkey % 40 WHEN 7 THEN 'INDETERMINATE' WHEN 8 THEN 'PASS' ELSE CASE o_orderkey % 7 WHEN 0 THEN 'FAIL' WHEN 6 THEN 'FAIL' WHEN 3 THEN 'INDETERMINATE' ELSE 'PASS' END END AS verdict,
  CASE o_orderkey % 3 WHEN 0 THEN 'salience_gap' WHEN 1 THEN 'anomaly_and_salience_gap' ELSE 'step1_anomaly_and_control_differential' END AS binding, o_orderkey % 2 = 0 AS step1, o_orderkey % 3 = 0 AS step2, o_orderkey % 5 = 0 AS step3,
  CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice) / 1000 END AS mdg, CASE WHEN o_orderkey % 6 <> 0 THEN floor(o_totalprice / 50000) END AS gap_over_mdg, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS scenario, o_orderkey % 23 % 5 AS n_matched_low, o_orderkey % 11 = 0 AS disagree FROM orders
), ev AS (SELECT * FROM dealt WHERE verdict <> 'INDETERMINATE'), power AS (SELECT * FROM ev WHERE scenario = 'B' AND mdg IS NOT NULL)"""


_EVENTS = _PRELUDE + f""",
market AS (SELECT date, avg(returns) AS mkt_ret, stddev_samp(returns) AS cs_std FROM panel GROUP BY date),
weeks AS (
  SELECT date_trunc('week', o_orderdate)::DATE AS date, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') / count(*) AS share_o,
         count(*) FILTER (o_orderstatus = 'F') / count(*) AS share_f, count(*) FILTER (o_orderstatus = 'P') / count(*) AS share_p FROM orders GROUP BY 1
), jumped AS (
  SELECT date, mkt_ret AS ret, (n % 11)::DOUBLE AS clarity, (1 + n % 3)::DOUBLE AS confidence, greatest(share_o, share_f, share_p) AS category_share,
         CASE WHEN share_o >= share_f AND share_o >= share_p THEN 'open' WHEN share_f >= share_p THEN 'share_f' ELSE 'share_p' END AS category
  FROM weeks JOIN market USING (date) WHERE n % 5 = 0 AND mkt_ret IS NOT NULL AND date BETWEEN '{FIRST}' AND '{LAST}'
), mapped AS (SELECT j.*, coalesce((SELECT min(tpos) FROM days c WHERE c.date >= j.date), -1) AS tpos FROM jumped j),
chained AS (
  SELECT *, sum(fresh) OVER (ORDER BY tpos, date) - 1 AS cluster FROM (SELECT *, CASE WHEN tpos - lag(tpos) OVER (ORDER BY tpos, date) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM mapped WHERE tpos >= 0)
), anchors AS (
  SELECT *, count(*) OVER (PARTITION BY cluster) AS episode_n_jumps FROM chained QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY clarity DESC, abs(ret) DESC, date) = 1
), scored AS (
  SELECT *, 0.5 * (clarity - avg(clarity) OVER ()) / stddev_samp(clarity) OVER () + 0.5 * (confidence - avg(confidence) OVER ()) / stddev_samp(confidence) OVER () AS consensus FROM anchors
), armed AS (
  SELECT *, CASE WHEN round(consensus, 9) <= round((SELECT quantile_cont(consensus, 0.25) FROM scored), 9) THEN 'low' WHEN round(consensus, 9) >= round((SELECT quantile_cont(consensus, 0.75) FROM scored), 9) THEN 'high' ELSE 'middle' END AS salience FROM scored
), events AS MATERIALIZED (
  SELECT *, 'E' || strftime(date, '%Y%m%d') AS event_id, tpos - {WIDTH // 2} AS window_start, tpos - {WIDTH // 2} + {WIDTH - 1} AS window_end,
         tpos - {WIDTH // 2} >= 0 AND tpos - {WIDTH // 2} + {WIDTH - 1} < (SELECT count(*) FROM days) AS usable FROM armed
), cal_ic AS (SELECT a.alpha_id, d.tpos, i.ic FROM (SELECT DISTINCT alpha_id FROM ics) a CROSS JOIN days d LEFT JOIN ics i ON i.alpha_id = a.alpha_id AND i.date = d.date),
means AS (
  SELECT alpha_id, tpos AS start, CASE WHEN n >= {LEAST} THEN m END AS mean FROM (
    SELECT alpha_id, tpos, avg(ic) OVER w AS m, count(ic) OVER w AS n, count(*) OVER w AS r FROM cal_ic WINDOW w AS (PARTITION BY alpha_id ORDER BY tpos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) WHERE r = {WIDTH}
), benchd AS (SELECT date, CASE WHEN count(*) >= 5 THEN avg(ic) END AS bench FROM ics WHERE alpha_id LIKE 'c%' GROUP BY date),
xy AS MATERIALIZED (SELECT alpha_id, d.tpos, CASE WHEN bench IS NOT NULL THEN ic END AS y, CASE WHEN ic IS NOT NULL THEN bench END AS x FROM cal_ic JOIN days d USING (tpos) LEFT JOIN benchd USING (date) WHERE alpha_id LIKE 'a%'),
starts AS (SELECT alpha_id, tpos AS start FROM xy WHERE tpos + {WIDTH - 1} <= (SELECT max(tpos) FROM days)),
outside AS (SELECT s.alpha_id, s.start, regr_slope(y, x) AS beta FROM starts s JOIN xy ON xy.alpha_id = s.alpha_id AND xy.tpos NOT BETWEEN s.start AND s.start + {WIDTH - 1} WHERE x IS NOT NULL GROUP BY ALL),
inside AS (SELECT s.alpha_id, s.start, count(x) AS n, avg(y) AS my, avg(x) AS mx FROM starts s JOIN xy ON xy.alpha_id = s.alpha_id AND xy.tpos BETWEEN s.start AND s.start + {WIDTH - 1} GROUP BY ALL),
lwo AS MATERIALIZED (SELECT alpha_id, start, beta, CASE WHEN n >= {LEAST} THEN my - beta * mx END AS d FROM inside JOIN outside USING (alpha_id, start)),
free AS (SELECT tpos AS start FROM days c WHERE tpos + {WIDTH - 1} <= (SELECT max(tpos) FROM days) AND NOT EXISTS (SELECT 1 FROM events e WHERE usable AND abs(e.window_start - c.tpos) < {WIDTH})),
eventd AS (SELECT alpha_id, event_id, salience, d FROM lwo JOIN events ON window_start = start WHERE usable),
pvals AS (SELECT e.alpha_id, e.event_id, avg((l.d >= e.d)::INT) AS p2 FROM eventd e JOIN lwo l ON l.alpha_id = e.alpha_id JOIN free f ON f.start = l.start WHERE e.d IS NOT NULL AND l.d IS NOT NULL AND e.salience = 'high' GROUP BY ALL)"""


def _test2(name: str, query, sql: str | None = None, dates: tuple[str, ...] = ()) -> None:
    register(name, query, None if sql is None else f"WITH {_EVENTS} {sql}", dates)


_test2("calendar", days, "SELECT date, tpos FROM days", ("date",))
_test2("market_covariates", lambda s, d: rounded(market(s, d)), "SELECT date, round(mkt_ret, 6) AS mkt_ret, round(cs_std, 6) AS cs_std FROM market", ("date",))
_test2("dominant_category", lambda s, d: rounded(_jumps(s, d).select("date", "category", "category_share")), "SELECT date, category, round(category_share, 6) AS category_share FROM jumped", ("date",))
def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jump table written as a workbook and read again, with its types."""
    path = f"{folder(spark)}/jumps-{uuid.uuid4().hex}.xlsx"
    write_sheet(raw_jumps(spark, sf_dir), path, "jumps by day", ["date"])
    back = read_jumps(spark, path, "jumps by day")
    return rounded(V.jumps(back, ["share_o", "share_f", "share_p"], FIRST, LAST, {"share_o": "open"}))


_test2("jumps_from_a_sheet", _sheet, "SELECT date, round(ret, 6) AS ret, clarity, confidence, category, round(category_share, 6) AS category_share FROM jumped", ("date",))
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages, dealt over nine hundred weeks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") % 900 * 7).cast("int")).alias("date"), F.col("text").alias("description"))


def _event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.described(events(spark, sf_dir), V.descriptions(passages(spark, sf_dir)))
    return rounded(V.event_list(found, pairs(spark, sf_dir)))


_TEXTS = """, told AS (SELECT date, t AS description FROM (SELECT DATE '1990-01-01' + (doc_id % 900 * 7)::INT AS date, regexp_replace(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+$', '') AS t FROM documents)
WHERE t <> '' AND lower(t) NOT IN ('nan', 'none') QUALIFY row_number() OVER (PARTITION BY date ORDER BY length(t), t) = 1)"""
_test2("as_of_map", lambda s, d: mapped(s, d).select("date", "tpos"), "SELECT date, tpos FROM mapped", ("date",))
_test2("decluster", lambda s, d: anchors(s, d).select("date", "tpos", "cluster", "episode_n_jumps"), "SELECT date, tpos, cluster::INT AS cluster, episode_n_jumps FROM anchors", ("date",))
_test2("salience", lambda s, d: rounded(V.salience(anchors(s, d)).select("date", "consensus", "salience")), "SELECT date, round(consensus, 6) AS consensus, salience FROM armed", ("date",))
_test2("event_windows", lambda s, d: events(s, d).select("event_id", "window_start", "window_end", "usable"), "SELECT event_id, window_start, window_end, usable FROM events")
_test2("window_covariates", lambda s, d: rounded(events(s, d).filter("usable").select("event_id", "realized_vol", "drawdown", "dispersion")), f"""
, r AS (SELECT e.event_id, c.tpos, mkt_ret, cs_std, product(1 + mkt_ret) OVER w AS c FROM events e JOIN days c ON c.tpos BETWEEN window_start AND window_end JOIN market mk ON mk.date = c.date WHERE usable AND mkt_ret IS NOT NULL WINDOW w AS (PARTITION BY e.event_id ORDER BY c.tpos)),
m AS (SELECT *, max(c) OVER (PARTITION BY event_id ORDER BY tpos) AS top FROM r)
SELECT event_id, CASE WHEN n >= {LEAST} THEN v END AS realized_vol, CASE WHEN n >= {LEAST} THEN dd END AS drawdown, CASE WHEN n >= {LEAST} THEN s END AS dispersion FROM events LEFT JOIN (
SELECT event_id, count(*) AS n, round(stddev_samp(mkt_ret) * sqrt(252), 6) AS v, round(max(1 - c / top), 6) AS dd, round(avg(cs_std), 6) AS s FROM m GROUP BY event_id) USING (event_id) WHERE usable""")
_test2("window_means", lambda s, d: rounded(M.window_means(grid(s, d), WIDTH, LEAST)), "SELECT alpha_id, start, round(mean, 6) AS mean FROM means")
_test2("ic_history", lambda s, d: rounded(M.history(grid(s, d), WIDTH, LEAST)), f"SELECT alpha_id, start + {WIDTH // 2} AS tpos, round(mean, 6) AS mean FROM means WHERE mean IS NOT NULL")
_test2("step1_thresholds", lambda s, d: rounded(thresholds(s, d)), "SELECT round(quantile_cont(mean, 0.95), 6) AS pooled, round(quantile_cont(mean - own, 0.95), 6) AS demeaned FROM means JOIN (SELECT alpha_id, avg(ic) AS own FROM ics GROUP BY 1) USING (alpha_id) WHERE alpha_id LIKE 'c%' AND mean IS NOT NULL")
_test2("placebo_windows", lambda s, d: M.placebo_starts(days(s, d), events(s, d), WIDTH), "SELECT start FROM free")
_test2("leave_window_out", lambda s, d: rounded(lwo(s, d), 5), "SELECT alpha_id, start, round(beta, 5) AS beta, round(d, 5) AS d FROM lwo")
_test2("event_differentials", lambda s, d: rounded(event_d(s, d), 5), "SELECT alpha_id, event_id, salience, round(d, 5) AS d FROM eventd")
_test2("step2_p", lambda s, d: rounded(p2(s, d).filter("p2 is not null").select("alpha_id", "event_id", "p2")), "SELECT alpha_id, event_id, round(p2, 6) AS p2 FROM pvals")
_test2("bh_fdr", lambda s, d: rounded(M.benjamini_hochberg(p2(s, d).filter("p2 is not null").select("alpha_id", "event_id", "p2"), "p2", ["alpha_id"], 0.2)), """
, k AS (SELECT *, row_number() OVER (PARTITION BY alpha_id ORDER BY p2) AS r, count(*) OVER (PARTITION BY alpha_id) AS m FROM pvals)
SELECT alpha_id, event_id, round(p2, 6) AS p2, round(least(1, (SELECT min(o.p2 * o.m / o.r) FROM k o WHERE o.alpha_id = k.alpha_id AND o.p2 >= k.p2)), 6) AS p2_q,
(SELECT min(o.p2 * o.m / o.r) FROM k o WHERE o.alpha_id = k.alpha_id AND o.p2 >= k.p2) <= 0.2 AS p2_reject FROM k""")
# the inverse of three by three covariances, written out; where drawdowns don't vary, that of the other two (the pseudo-inverse)
_PAIRS = f"""
, r AS MATERIALIZED (SELECT e.event_id, c.tpos, mkt_ret, cs_std, product(1 + mkt_ret) OVER w AS c FROM events e JOIN days c ON c.tpos BETWEEN window_start AND window_end JOIN market mk ON mk.date = c.date WHERE usable AND mkt_ret IS NOT NULL WINDOW w AS (PARTITION BY e.event_id ORDER BY c.tpos)),
tops AS (SELECT *, max(c) OVER (PARTITION BY event_id ORDER BY tpos) AS top FROM r),
cov AS MATERIALIZED (SELECT event_id, salience, x, y, z FROM events JOIN (SELECT event_id, stddev_samp(mkt_ret) * sqrt(252) AS x, max(1 - c / top) AS y, avg(cs_std) AS z FROM tops GROUP BY event_id HAVING count(*) >= {LEAST}) USING (event_id) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
s3 AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS c, var_samp(y) AS d, covar_samp(y, z) AS e, var_samp(z) AS f FROM cov),
inv AS (SELECT CASE WHEN d > 0 THEN xx ELSE f / flat END AS xx, CASE WHEN d > 0 THEN xy ELSE 0 END AS xy, CASE WHEN d > 0 THEN xz ELSE -c / flat END AS xz, CASE WHEN d > 0 THEN yy ELSE 0 END AS yy, CASE WHEN d > 0 THEN yz ELSE 0 END AS yz, CASE WHEN d > 0 THEN zz ELSE a / flat END AS zz
  FROM (SELECT *, a * f - c * c AS flat, (d * f - e * e) / det AS xx, (c * e - b * f) / det AS xy, (b * e - c * d) / det AS xz, (a * f - c * c) / det AS yy, (b * c - a * e) / det AS yz, (a * d - b * b) / det AS zz
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s3))),
apart AS MATERIALIZED (SELECT h.event_id, l.event_id AS low_id, sqrt(greatest(0, xx * (h.x - l.x) ** 2 + yy * (h.y - l.y) ** 2 + zz * (h.z - l.z) ** 2 + 2 * (xy * (h.x - l.x) * (h.y - l.y) + xz * (h.x - l.x) * (h.z - l.z) + yz * (h.y - l.y) * (h.z - l.z)))) AS distance
  FROM cov h, cov l, inv WHERE h.salience = 'high' AND l.salience = 'low'),
near AS (SELECT * FROM apart WHERE distance <= 2),
gapped AS MATERIALIZED (SELECT h.alpha_id, h.event_id, any_value(h.d) - avg(l.d) AS gap, count(*) AS n_low, string_agg(n.low_id, '|' ORDER BY n.low_id) AS low_ids
  FROM eventd h JOIN near n USING (event_id) JOIN eventd l ON l.alpha_id = h.alpha_id AND l.event_id = n.low_id WHERE h.d IS NOT NULL AND l.d IS NOT NULL GROUP BY h.alpha_id, h.event_id)"""
_test2("mahalanobis_matches", lambda s, d: rounded(pairs(s, d)), f"{_PAIRS} SELECT event_id, low_id, round(distance, 6) AS distance FROM near")
_test2("event_list", _event_list, f"""{_PAIRS} {_TEXTS}, n AS (SELECT event_id, count(*) AS matches FROM near GROUP BY 1)
SELECT event_id, date, round(ret, 6) AS ret, round(consensus, 6) AS consensus, coalesce(matches, 0) AS matches, CASE WHEN description IS NULL THEN '[no description]' WHEN length(description) > 58 THEN regexp_replace(description[1:55], '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+$', '') || '...' ELSE description END || '  (' || category || ')' AS label
FROM events LEFT JOIN n USING (event_id) LEFT JOIN told USING (date) WHERE usable AND salience = 'high'""", ("date",))
_test2("event_counts", lambda s, d: V.event_counts(_jumps(s, d), events(s, d)), """, c AS (SELECT (SELECT count(*) FROM jumped) AS jumps, count(*) AS episodes, count(*) FILTER (usable AND salience = 'high') AS high, count(*) FILTER (usable AND salience = 'low') AS low, count(*) - count(*) FILTER (usable AND salience IN ('high', 'low')) AS middle FROM events)
SELECT 'events' AS section, item, value::DOUBLE AS value FROM (UNPIVOT c ON COLUMNS(*) INTO NAME item VALUE value)""")
_test2("passage_descriptions", lambda s, d: V.descriptions(passages(s, d)), f"{_TEXTS} SELECT date, description FROM told", ("date",))
_test2("salience_gaps", lambda s, d: rounded(gaps(s, d).select("alpha_id", "event_id", "gap", "n_low", F.array_join("low_ids", "|").alias("low_ids")), 5), f"{_PAIRS} SELECT alpha_id, event_id, round(gap, 5) AS gap, n_low, low_ids FROM gapped")
_test2("scenario_routes", lambda s, d: rounded(routes(s, d)), f"""{_PAIRS}
SELECT e.alpha_id, e.event_id, CASE WHEN n_low IS NULL THEN 'A' ELSE 'B' END AS scenario, coalesce(n_low, 0) AS n_matched_low, coalesce(low_ids, '') AS matched_low_ids, round(nearest, 6) AS nearest
FROM eventd e LEFT JOIN gapped g USING (alpha_id, event_id) LEFT JOIN (SELECT event_id, min(distance) AS nearest FROM apart GROUP BY event_id) USING (event_id) WHERE salience = 'high'""")
_test2("step1_flags", lambda s, d: step1(s, d).drop("mean"), """
, own AS (SELECT alpha_id, avg(ic) AS own FROM ics GROUP BY alpha_id), thr AS (SELECT quantile_cont(mean, 0.95) AS pooled, quantile_cont(mean - own, 0.95) AS demeaned FROM means JOIN own USING (alpha_id) WHERE alpha_id LIKE 'c%' AND mean IS NOT NULL),
f AS (SELECT alpha_id, event_id, coalesce(mean > pooled, false) AS p, coalesce(mean - own > demeaned, false) AS q FROM means JOIN own USING (alpha_id) JOIN events ON window_start = start, thr WHERE usable AND alpha_id LIKE 'a%')
SELECT alpha_id, event_id, p AS pooled_flag, q AS demeaned_flag, p <> q AS disagree, p OR q AS step1 FROM f""")
# days of an event and its low events, pooled; each draw sorts them by its keys and deals them into slots of the old sizes
_DRAWN = f"""{_PAIRS},
slots AS (SELECT alpha_id, event_id, event_id AS slot, 0 AS low FROM gapped UNION ALL SELECT g.alpha_id, g.event_id, n.low_id, 1 FROM gapped g JOIN near n USING (event_id) JOIN eventd l ON l.alpha_id = g.alpha_id AND l.event_id = n.low_id WHERE l.d IS NOT NULL),
dayd AS (SELECT l.alpha_id, e.event_id AS slot, x.tpos, y - beta * x AS d FROM events e JOIN lwo l ON l.start = window_start JOIN xy x ON x.alpha_id = l.alpha_id AND x.tpos BETWEEN window_start AND window_end WHERE usable AND x IS NOT NULL AND beta IS NOT NULL),
pool AS MATERIALIZED (SELECT alpha_id, event_id, slot, low, d, row_number() OVER (PARTITION BY alpha_id, event_id ORDER BY low, slot, tpos) - 1 AS i, count(*) OVER (PARTITION BY alpha_id, event_id) AS n, {seed_sql("alpha_id", "event_id")} AS seed FROM slots JOIN dayd USING (alpha_id, slot)),
drawn AS (SELECT alpha_id, event_id, draw, d, row_number() OVER (PARTITION BY alpha_id, event_id, draw ORDER BY key, i) - 1 AS place FROM (SELECT *, {keys_sql("seed", "draw", "n", "i")} AS key FROM pool, (SELECT unnest(range(10000)) AS draw))),
slot_means AS (SELECT p.alpha_id, p.event_id, draw, p.low, p.slot, avg(r.d) AS m FROM drawn r JOIN pool p ON p.alpha_id = r.alpha_id AND p.event_id = r.event_id AND p.i = r.place GROUP BY ALL),
nulls AS (SELECT alpha_id, event_id, draw, avg(m) FILTER (low = 0) - avg(m) FILTER (low = 1) AS gap FROM slot_means GROUP BY ALL),
seen AS (SELECT alpha_id, event_id, avg(m) FILTER (low = 0) - avg(m) FILTER (low = 1) AS observed FROM (SELECT alpha_id, event_id, low, slot, avg(d) AS m FROM pool GROUP BY ALL) GROUP BY ALL),
perms AS MATERIALIZED (SELECT alpha_id, event_id, any_value(observed) AS observed, avg((gap >= observed - 1e-12)::INT) AS p3, quantile_cont(gap, 0.95) AS mdg FROM nulls JOIN seen USING (alpha_id, event_id) GROUP BY ALL)"""
_test2("permutation_gaps", lambda s, d: rounded(permuted(s, d)), f"{_DRAWN} SELECT alpha_id, event_id, round(observed, 6) AS observed, round(p3, 6) AS p3, round(mdg, 6) AS mdg FROM perms")
# severity made orthogonal column by column, the differentials' residual, and for each draw a dot product over what it leaves of consensus
_FLAT = lambda a, *by: " - ".join([a, *(f"coalesce(sum({a} * {b}) OVER w / nullif(sum({b} * {b}) OVER w, 0), 0) * {b}" for b in by)])
_test2("salience_gradient", lambda s, d: rounded(M.salience_gradient(event_d(s, d), events(s, d)), 5), f"""{_PAIRS},
met AS (SELECT alpha_id, e.event_id, d, consensus, c.x, c.y, c.z, row_number() OVER (PARTITION BY alpha_id ORDER BY e.event_id) - 1 AS i, count(*) OVER (PARTITION BY alpha_id) AS n FROM eventd e JOIN events v USING (event_id) JOIN cov c USING (event_id) WHERE d IS NOT NULL),
g0 AS (SELECT *, x - avg(x) OVER w AS x0, y - avg(y) OVER w AS y0, z - avg(z) OVER w AS z0, consensus - avg(consensus) OVER w AS c0, d - avg(d) OVER w AS d0 FROM met WINDOW w AS (PARTITION BY alpha_id)),
g1 AS (SELECT *, {_FLAT("y0", "x0")} AS y1 FROM g0 WINDOW w AS (PARTITION BY alpha_id)),
g2 AS (SELECT *, {_FLAT("z0", "x0", "y1")} AS z1 FROM g1 WINDOW w AS (PARTITION BY alpha_id)),
g3 AS MATERIALIZED (SELECT *, {_FLAT("d0", "x0", "y1", "z1")} AS rest, {seed_sql("alpha_id")} AS seed FROM g2 WINDOW w AS (PARTITION BY alpha_id)),
turned AS (SELECT alpha_id, draw, c0, row_number() OVER (PARTITION BY alpha_id, draw ORDER BY key, i) - 1 AS place FROM (SELECT *, {keys_sql("seed", "draw", "n", "i")} AS key FROM g3, (SELECT unnest(range(1000)) AS draw))),
mixed AS (SELECT g.alpha_id, draw, t.c0 AS c, g.x0, g.y1, g.z1, g.rest FROM turned t JOIN g3 g ON g.alpha_id = t.alpha_id AND g.i = t.place UNION ALL SELECT alpha_id, -1, c0, x0, y1, z1, rest FROM g3),
slopes AS (SELECT alpha_id, draw, sum(c * rest) / (sum(c * c) - {" - ".join(f"coalesce(sum(c * {b}) ** 2 / nullif(sum({b} * {b}), 0), 0)" for b in ("x0", "y1", "z1"))}) AS slope, sum(c * c) AS total, {" + ".join(f"coalesce(sum(c * {b}) ** 2 / nullif(sum({b} * {b}), 0), 0)" for b in ("x0", "y1", "z1"))} AS part FROM mixed GROUP BY ALL)
SELECT o.alpha_id, CASE WHEN any_value(n) >= 6 THEN round(any_value(o.slope), 5) END AS slope, CASE WHEN any_value(n) >= 6 THEN round(avg((s.slope >= o.slope - 1e-9 * abs(o.slope))::INT), 5) END AS p, any_value(n) AS n_episodes, CASE WHEN any_value(n) >= 6 THEN round(any_value(o.part / o.total), 5) END AS r2_severity
FROM slopes o JOIN slopes s ON s.alpha_id = o.alpha_id AND s.draw >= 0 JOIN (SELECT alpha_id, count(*) AS n FROM met GROUP BY 1) c ON c.alpha_id = o.alpha_id WHERE o.draw = -1 GROUP BY o.alpha_id""")
_STEPS = f"""{_DRAWN},
own AS (SELECT alpha_id, avg(ic) AS own FROM ics GROUP BY alpha_id), thr AS (SELECT quantile_cont(mean, 0.95) AS pooled, quantile_cont(mean - own, 0.95) AS demeaned FROM means JOIN own USING (alpha_id) WHERE alpha_id LIKE 'c%' AND mean IS NOT NULL),
flags AS (SELECT alpha_id, event_id, coalesce(mean > pooled, false) AS a, coalesce(mean - own > demeaned, false) AS b FROM means JOIN own USING (alpha_id) JOIN events ON window_start = start, thr WHERE usable AND alpha_id LIKE 'a%'),
tested AS (SELECT e.alpha_id, e.event_id, e.d, p2, p3, observed, mdg, coalesce(a OR b, false) AS step1, coalesce(a <> b, false) AS disagree, CASE WHEN n_low IS NULL THEN 'A' ELSE 'B' END AS scenario, coalesce(n_low, 0) AS n_matched_low, coalesce(low_ids, '') AS matched_low_ids, nearest,
  row_number() OVER (PARTITION BY e.alpha_id ORDER BY p2 NULLS LAST) AS r2, count(p2) OVER (PARTITION BY e.alpha_id) AS m2, row_number() OVER (PARTITION BY e.alpha_id ORDER BY p3 NULLS LAST) AS r3, count(p3) OVER (PARTITION BY e.alpha_id) AS m3
  FROM eventd e LEFT JOIN pvals USING (alpha_id, event_id) LEFT JOIN flags USING (alpha_id, event_id) LEFT JOIN perms USING (alpha_id, event_id) LEFT JOIN gapped USING (alpha_id, event_id) LEFT JOIN (SELECT event_id, min(distance) AS nearest FROM apart GROUP BY event_id) USING (event_id) WHERE e.salience = 'high'),
adjusted AS (SELECT t.*, (SELECT least(1, min(o.p2 * o.m2 / o.r2)) FROM tested o WHERE o.alpha_id = t.alpha_id AND o.p2 >= t.p2) AS p2_q, (SELECT least(1, min(o.p3 * o.m3 / o.r3)) FROM tested o WHERE o.alpha_id = t.alpha_id AND o.p3 >= t.p3) AS p3_q FROM tested t),
stepped AS (SELECT *, coalesce(p2_q <= 0.05 AND d > 0, false) AS step2, coalesce(p3_q <= 0.05 AND observed > 0, false) AS step3, observed / nullif(greatest(mdg, 0), 0) AS gap_over_mdg, d IS NOT NULL AND p2 IS NOT NULL AS known FROM adjusted),
judged AS MATERIALIZED (SELECT *, CASE WHEN NOT known THEN 'INDETERMINATE' WHEN step1 AND step2 OR step3 THEN 'FAIL' ELSE 'PASS' END AS verdict,
  CASE WHEN NOT known THEN 'insufficient_data' WHEN step1 AND step2 AND step3 THEN 'anomaly_and_salience_gap' WHEN step3 THEN 'salience_gap' WHEN step1 AND step2 THEN 'step1_anomaly_and_control_differential' ELSE 'none' END AS binding FROM stepped)"""
_test2("event_verdicts", lambda s, d: rounded(verdicts(s, d), 5), f"""{_STEPS} SELECT alpha_id, event_id, {", ".join(f"round({c}, 5) AS {c}" for c in ("d", "p2", "p2_q", "p3", "p3_q", "observed", "mdg", "gap_over_mdg", "nearest"))}, scenario, n_matched_low, matched_low_ids, step1, disagree, step2, step3, verdict, binding FROM judged""")
_test2("signal_synthesis", lambda s, d: rounded(M.synthesis(verdicts(s, d)), 5), f"""{_STEPS}, counted AS (
SELECT alpha_id, count(*) FILTER (known) AS events_tested, count(*) FILTER (verdict = 'FAIL') AS events_failed, count(*) FILTER (known AND step1) AS step1_anomaly_flags, count(*) FILTER (known AND step2) AS step2_differential_flags, count(*) FILTER (known AND step3) AS step3_salience_gap_flags,
  round(quantile_cont(mdg, 0.5) FILTER (known), 5) AS step3_median_mdg, round(max(gap_over_mdg) FILTER (known), 5) AS step3_max_gap_over_mdg, string_agg(DISTINCT binding, ', ' ORDER BY binding) FILTER (verdict = 'FAIL') AS modes FROM judged GROUP BY alpha_id)
SELECT * EXCLUDE modes, CASE WHEN events_tested = 0 THEN 'INDETERMINATE' WHEN events_failed > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, coalesce(modes, 'none') AS binding_failure_mode FROM counted""")
register("synthesis_cases", lambda s, d: rounded(M.synthesis(_dealt(s, d))), f"""{_DEALT}
SELECT alpha_id, events_tested, events_failed, coalesce(step1, 0) AS step1_anomaly_flags, coalesce(step2, 0) AS step2_differential_flags, coalesce(step3, 0) AS step3_salience_gap_flags, step3_median_mdg, step3_max_gap_over_mdg, CASE WHEN events_tested = 0 THEN 'INDETERMINATE' WHEN events_failed > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, coalesce(modes, 'none') AS binding_failure_mode
FROM (SELECT alpha_id, sum((verdict <> 'INDETERMINATE')::INT)::BIGINT AS events_tested, sum((verdict = 'FAIL')::INT)::BIGINT AS events_failed FROM dealt GROUP BY 1) LEFT JOIN
(SELECT alpha_id, sum(step1::INT)::BIGINT AS step1, sum(step2::INT)::BIGINT AS step2, sum(step3::INT)::BIGINT AS step3, round(median(mdg), 6) AS step3_median_mdg, max(gap_over_mdg) AS step3_max_gap_over_mdg FROM ev GROUP BY 1) USING (alpha_id) LEFT JOIN
(SELECT alpha_id, string_agg(binding, ', ' ORDER BY binding) AS modes FROM (SELECT DISTINCT alpha_id, binding FROM ev WHERE verdict = 'FAIL') GROUP BY 1) USING (alpha_id)""")
register("report_cases", lambda s, d: rounded(M.report(_dealt(s, d))), f"""{_DEALT}
SELECT 'results' AS section, 'tests' AS item, count(*)::DOUBLE AS value FROM ev UNION ALL SELECT 'results', 'scenario_a', count(*) FROM ev WHERE scenario = 'A' UNION ALL SELECT 'results', 'scenario_b', count(*) FROM ev WHERE scenario = 'B' UNION ALL SELECT 'results', 'step1_variants_disagree', count(*) FROM ev WHERE disagree
UNION ALL SELECT 'binding', binding, count(*) FROM ev WHERE verdict = 'FAIL' GROUP BY 2 UNION ALL SELECT 'detection_floor', 'tests', count(*) FROM power UNION ALL SELECT 'detection_floor', 'median', round(median(mdg), 6) FROM power UNION ALL SELECT 'detection_floor', 'least', round(min(mdg), 6) FROM power
UNION ALL SELECT 'detection_floor', 'greatest', round(max(mdg), 6) FROM power UNION ALL SELECT 'detection_floor', 'greatest_ratio', max(gap_over_mdg) FROM power UNION ALL SELECT 'detection_floor', 'reached', count(*) FROM power WHERE gap_over_mdg >= 1""")
register("power_cases", lambda s, d: rounded(M.power_by_event(_dealt(s, d), 2)), f"""{_DEALT}, m AS (SELECT event_id, any_value(n_matched_low) AS matches, median(mdg) AS mdg FROM power GROUP BY 1),
p AS (SELECT *, 1 + (SELECT count(*) FROM m o WHERE o.mdg > m.mdg OR o.mdg = m.mdg AND o.event_id < m.event_id) AS place FROM m) SELECT event_id, matches, round(mdg, 6) AS mdg, place::INT AS place FROM p WHERE place <= 2 OR place > (SELECT count(*) FROM m) - 2""")
_test2("test2_report", lambda s, d: rounded(M.report(verdicts(s, d)), 5), f"""{_STEPS}, ev AS (SELECT * FROM judged WHERE known), power AS (SELECT * FROM ev WHERE scenario = 'B' AND mdg IS NOT NULL)
SELECT 'results' AS section, item, value::DOUBLE AS value FROM (UNPIVOT (SELECT count(*) AS tests, count(*) FILTER (scenario = 'A') AS scenario_a, count(*) FILTER (scenario = 'B') AS scenario_b, count(*) FILTER (disagree) AS step1_variants_disagree FROM ev) ON COLUMNS(*) INTO NAME item VALUE value)
UNION ALL SELECT 'binding', binding, count(*) FROM ev WHERE verdict = 'FAIL' GROUP BY binding
UNION ALL SELECT 'detection_floor', item, round(value, 5) FROM (SELECT unnest(['tests', 'median', 'least', 'greatest', 'greatest_ratio', 'reached']) AS item, unnest([count(*), quantile_cont(mdg, 0.5), min(mdg), max(mdg), max(gap_over_mdg), count(*) FILTER (gap_over_mdg >= 1)]) AS value FROM power)""")
_test2("power_by_event", lambda s, d: rounded(M.power_by_event(verdicts(s, d)), 5), f"""{_STEPS}, power AS (SELECT event_id, any_value(n_matched_low) AS matches, quantile_cont(mdg, 0.5) AS m FROM judged WHERE known AND scenario = 'B' AND mdg IS NOT NULL GROUP BY event_id),
placed AS (SELECT event_id, matches, round(m, 5) AS mdg, row_number() OVER (ORDER BY m DESC, event_id) AS place, count(*) OVER () AS n FROM power) SELECT event_id, matches, mdg, place::INT AS place FROM placed WHERE place <= 3 OR place > n - 3""")
_test2("histogram", lambda s, d: M.histogram(ic_panel(s, d), "ic"), ", e AS (SELECT min(ic) AS a, max(ic) AS b FROM ics) SELECT least(19, floor((ic - a) / (b - a) * 20))::INT AS bin, count(*) AS n FROM ics, e GROUP BY 1")
