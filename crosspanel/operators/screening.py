"""The screening stage: many signals over one panel, each of which may fail on its own.

A signal is a formula, a function from the panel to a column, or a function from the panel to a table (date, symbol, signal).
All are analysed one by one; those that can be run together as one plan. If that plan fails while it runs, the batch is
halved until the culprits are alone: each becomes a FAILED_EXECUTION row with its message, and the others' figures stay.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import no_nan
from ..plans.compiler import evaluate, evaluate_observed
from ..plans.dialect import translate
from ..plans.expr import Node, parse
from ..sources.cache import folder
from ..sources.panel import PRICES, densify
from . import evaluate as E
from .artifacts import first_code_block

#: Decimals of the screening table's figures.
DIGITS = {"annualized_return": 4, "annualized_vol": 4, "sharpe_ratio": 4, "dsr_z_score": 2, "dsr": 4, "mean_rank_ic": 5, "ic_std": 5, "ic_information_ratio": 4}
COLUMNS = ("alpha_id", "model", "theme", "annualized_return", "annualized_vol", "sharpe_ratio", "dsr_z_score", "dsr", "ic_execution", "mean_rank_ic", "ic_std", "ic_information_ratio", "ic_n_days", "status", "error")
_LONG = "alpha_id string, date date, symbol string, signal double"
#: What each table of signals has beside a column for each: the row's return and forward return.
_BESIDE = ("returns", "_fwd")


@dataclass(frozen=True)
class Signal:
    """``make``: a formula (text or graph), or a function of the panel that gives a formula's graph, a column or a table.

    ``calendar``: a formula counts market dates, else a symbol's own rows; functions always get the panel as it is.
    """

    alpha_id: str
    make: str | Node | Callable[[DataFrame], Node | Column | DataFrame]
    model: str = "own"
    theme: str | None = None
    calendar: bool = True


@contextmanager
def ansi(spark: SparkSession):
    """Inside of the block an overflow or a bad cast is an error, not a wrong number, whatever the session says."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def said(error: Exception) -> str:
    """An error in one line: Spark's condition and message, or the last line of a worker's trace."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    traced = [i for i, x in enumerate(lines) if x.startswith("Traceback")]
    if traced:
        plain = [x for x in lines[traced[-1] :] if re.match(r"\w[\w.]*(Error|Exception|Warning)?: ", x)]
        return plain[-1] if plain else lines[-1]
    named = next((x for x in lines if re.match(r"\[[A-Z][A-Z0-9_.]+\]", x)), None)
    return named or (f"{type(error).__name__}: {lines[0]}" if lines else type(error).__name__)


class Batch:
    """Signals over one panel. ``parts`` has a table with a column for each signal that ran, ``failures`` a message for each that didn't."""

    def __init__(self, panel: DataFrame, signals: Iterable[Signal], convention: str = "open_t1"):
        """The panel and its forward returns are written first, so that what fails later isn't its input."""
        self.spark = panel.sparkSession
        self.root = f"{folder(self.spark)}/screen-{uuid.uuid4().hex}"
        self.listed = list(signals)
        names = [s.alpha_id for s in self.listed]
        if repeated := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"signals named twice: {repeated}")
        self._columns = {n: f"_s{i}" for i, n in enumerate(names)}
        self._rows = self._write(_with_forward(self._write(panel, "panel"), convention), "rows")
        self.panel = self._rows.drop("_fwd")
        self.failures: dict[str, str] = {}
        self.runs = 0
        self.parts: list[DataFrame] = []
        with ansi(self.spark):
            self._run([a for s in self.listed if (a := self._analysed(s))])

    @property
    def signals(self) -> DataFrame:
        """``alpha_id, date, symbol, signal`` of all that ran: a row for each signal and row of the panel."""
        return self._together([E.long_signals(p, self._signals_of(p)) for p in self.parts], _LONG)

    def _signals_of(self, part: DataFrame) -> list[str]:
        return [c for c in part.columns if c in self._columns.values()]

    def _together(self, long: list[DataFrame], schema: str) -> DataFrame:
        """Tables of many signals as one, with the signals' own names."""
        whole = self.spark.createDataFrame([], schema)
        if not long:
            return whole
        own = F.create_map(*(F.lit(x) for n, c in self._columns.items() for x in (c, n)))
        for part in long:
            whole = whole.unionByName(part.withColumn("alpha_id", F.element_at(own, F.col("alpha_id"))))
        return whole

    def rank_ic(self, min_names: int = 20) -> DataFrame:
        """``alpha_id, date, ic, n_names``: rows go by date once for all signals of a table; no signal meets the forward returns in a join."""
        each = [E.rank_ic_wide(p.filter("symbol is not null").withColumnRenamed("_fwd", "fwd"), self._signals_of(p), min_names) for p in self.parts]
        return self._together(each, "alpha_id string, date date, ic double, n_names long")

    def portfolio_returns(self) -> DataFrame:
        """``alpha_id, date, ret``: rows go by symbol once for all signals of a table."""
        each = [E.portfolio_returns_wide(p.filter("symbol is not null"), self._signals_of(p)) for p in self.parts]
        return self._together(each, "alpha_id string, date date, ret double")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _analysed(self, signal: Signal) -> tuple[Signal, Node | Column | DataFrame] | None:
        """What the signal's plan is made from, if it can be built and analysed alone."""
        try:
            made = parse(signal.make) if isinstance(signal.make, str) else signal.make if isinstance(signal.make, Node) else signal.make(self.panel)
            if isinstance(made, Column):
                self.panel.select(made)  # the forward returns beside the panel aren't a signal's to see
            for _, frame in self._frames([(signal, made)]):
                frame.schema  # noqa: B018  a remote session analyses here
            return signal, made
        except Exception as e:  # whatever a signal's code raises is that signal's failure
            self.failures[signal.alpha_id] = said(e)
            return None

    def _frames(self, batch: list[tuple[Signal, Node | Column | DataFrame]]) -> list[tuple[list[tuple[Signal, Node | Column | DataFrame]], DataFrame]]:
        """Signals with their frame: ``date, symbol``, the returns beside and a column for each; one for formulas of each axis, for columns, and for each signal's own table."""
        frames = []
        column = lambda s: self._columns[s.alpha_id]
        for calendar in (True, False):
            nodes = [(s, m) for s, m in batch if isinstance(m, Node) and s.calendar == calendar]
            if nodes:
                frames.append((nodes, (evaluate_observed if calendar else evaluate)(self._rows, {column(s): m for s, m in nodes}, _BESIDE)))
        columns = [(s, m) for s, m in batch if isinstance(m, Column)]
        if columns:
            frames.append((columns, self._rows.select("date", "symbol", *_BESIDE, *(no_nan(m.cast("double")).alias(column(s)) for s, m in columns))))
        for s, m in batch:
            if isinstance(m, DataFrame):
                frames.append(([(s, m)], self._aligned(s.alpha_id, m)))
            elif not isinstance(m, Node | Column):
                raise TypeError(f"a signal is a column or a table, not {type(m).__name__}")
        return frames

    def _aligned(self, name: str, table: DataFrame) -> DataFrame:
        """A signal's own table on the rows of the panel; two values for one row are an error when it runs."""
        own = self._columns[name]
        one = table.groupBy(F.col("date").cast("date").alias("date"), F.col("symbol").cast("string").alias("symbol")).agg(F.first(no_nan(F.col("signal").cast("double"))).alias("signal"), F.count(F.lit(1)).alias("n"))
        checked = one.select("date", "symbol", F.when(F.col("n") > 1, F.raise_error(F.lit(f"{name}: two values for one date and symbol")).cast("double")).otherwise(F.col("signal")).alias(own))
        return self._rows.select("date", "symbol", *_BESIDE).join(checked, ["date", "symbol"], "left")

    def _run(self, batch: list[tuple[Signal, Node | Column | DataFrame]]) -> None:
        if not batch:
            return
        self.runs += 1
        for group, frame in self._frames(batch):
            try:
                self.parts.append(self._write(frame, "signals"))
            except Exception as e:  # only the signals that ran with the culprit run again
                if len(group) == 1:
                    self.panel.count()  # if this fails too, the cluster or the storage does, and no signal is to blame
                    self.failures[group[0][0].alpha_id] = said(e)
                    continue
                half = len(group) // 2
                self._run(group[:half])
                self._run(group[half:])


def _with_forward(panel: DataFrame, convention: str) -> DataFrame:
    """The panel with ``_fwd``, the forward return on market dates; rows without a symbol have none."""
    more = tuple(c for c in panel.columns if c not in ("date", "symbol", *PRICES, "returns"))
    seen = densify(panel, more).withColumn("_fwd", E.forward_return(convention)).filter("observed").select(*panel.columns, "_fwd")
    return seen.unionByName(panel.filter("symbol is null").withColumn("_fwd", F.lit(None).cast("double")))


def code_signals(artifacts: DataFrame, trials: str = "model", calendar: bool = False) -> list[Signal]:
    """Artifacts (alpha_id, model, theme, raw_response) as signals: the first block of code of each response, read and never run.

    A response without code, and code that the engine can't read, are signals that fail with their reason. Some hundred rows come to the driver.
    """

    def make(code: str | None) -> Callable[[DataFrame], Node]:
        def build(_: DataFrame) -> Node:
            if code is None:
                raise ValueError("no Python code block in the response")
            return translate(code)

        return build

    rows = artifacts.select("alpha_id", F.col(trials).alias("model"), "theme", first_code_block(F.col("raw_response")).alias("code")).orderBy("alpha_id").collect()
    return [Signal(r["alpha_id"], make(r["code"]), r["model"], r["theme"], calendar) for r in rows]


def screening_table(panel: DataFrame, signals: Iterable[Signal], convention: str = "open_t1", min_names: int = 20, level: float = 0.95, digits: dict[str, int] = DIGITS) -> DataFrame:
    """One row for each signal: ``alpha_id, model, theme``, performance, deflated Sharpe ratio, rank correlations, ``status, error``.

    All signals count as trials of their model, failed ones too. Figures of failed signals are missing, their days of rank
    correlation are 0; below three days the others' correlations are missing. Figures in ``digits`` are rounded. A signal without any value has flat returns.
    """
    if convention not in E.CONVENTIONS:
        raise ValueError(f"convention must be one of {E.CONVENTIONS}, not {convention!r}")
    batch = Batch(panel, signals, convention)
    spark = batch.spark
    listed = spark.createDataFrame([(s.alpha_id, s.model, s.theme, batch.failures.get(s.alpha_id)) for s in batch.listed], "alpha_id string, model string, theme string, error string")
    good, lost = listed.filter("error is null").drop("error"), listed.filter("error is not null")
    ic = E.ic_summary(batch.rank_ic(min_names))
    done = E.performance(batch.portfolio_returns()).join(F.broadcast(good), "alpha_id")
    screened = E.screen(done, E.trials_per_model(listed), level).join(ic, "alpha_id", "left")
    screened = screened.withColumns({"ic_execution": F.lit(convention), "ic_n_days": F.coalesce("ic_n_days", F.lit(0)).cast("long")})
    table = E.with_failures(screened, lost).select(*COLUMNS)
    return table.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in COLUMNS))
