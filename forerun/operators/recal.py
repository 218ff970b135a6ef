"""Volatility-adaptive thresholds: a move-rate target solved per symbol root, and the gates a result must pass."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HOUR, Config
from ..functions import exprs as E
from . import fold as K
from .relational import medians

log = logging.getLogger("forerun")

#: The search: the greatest threshold tried, halvings, and how many of them one pass over the data settles.
CAP, HALVINGS, LEVELS = 1e6, 16, 4


def solver(target: float, floor: float):
    """The threshold whose rate falls to the target, as a generator: it asks for rates of lists of thresholds.

    The floor where its rate is no more than the target; else the upper end doubles while its rate is no less, and the
    interval is halved; at equality the lower end moves. Thresholds that the next steps may need are asked for at once.
    """
    if floor <= 0:
        floor = 1e-6  # doubling nothing never ends
    doubled = [floor]
    while doubled[-1] < CAP:
        doubled.append(2 * doubled[-1])
    rates = yield doubled
    if rates[0] <= target:
        return floor
    hi = next((b for b, r in zip(doubled[1:], rates[1:]) if r < target or b >= CAP), doubled[-1])
    lo = floor
    for _ in range(HALVINGS // LEVELS):
        points = [lo, hi]
        for _ in range(LEVELS):
            points = sorted([*points, *((a + b) / 2 for a, b in zip(points, points[1:]))])
        known = dict(zip(points[1:-1], (yield points[1:-1])))
        for _ in range(LEVELS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if known[mid] >= target else (lo, mid)
    return (lo + hi) / 2


def solve(rate: Callable[[float], float], target: float, floor: float) -> float:
    """``solver`` on a function."""
    search, ask = solver(target, floor), None
    try:
        ask = next(search)
        while True:
            ask = search.send([rate(b) for b in ask])
    except StopIteration as end:
        return end.value


def unit_bps(quotes: DataFrame, cfg: Config) -> DataFrame:
    """(sym, n, span_hours, unit): ticks, hours of the event clock from the first to the last received, and the floor.

    A threshold below the median spread, or below the deviation of one step in the detector's basis, would only count
    noise.
    """
    w = Window.partitionBy("sym").orderBy("recv_us", "seq")
    rows = quotes.select("sym", "recv_us", "event_us", "seq", ((F.col("ask") - F.col("bid")) / F.col("mid") * 10000).alias("spread"), E.change(cfg.basis, F.lag("mid").over(w), F.col("mid")).alias("step"))
    at = F.struct("recv_us", "seq")
    span = ((F.max_by("event_us", at) - F.min_by("event_us", at)) / HOUR).alias("span_hours")
    stats = rows.groupBy("sym").agg(F.count("*").alias("n"), span, F.coalesce(F.stddev_pop("step"), F.lit(0.0)).alias("deviation"))
    both = stats.join(medians(rows, ["sym"], "spread", "spread"), "sym")
    return both.select("sym", "n", "span_hours", F.greatest("spread", 10000 * F.col("deviation")).alias("unit"))


def move_rates(quotes: DataFrame, thresholds: dict[str, list[float]], cfg: Config) -> dict[str, list[int]]:
    """How often winreset fires on each root's series at each of its thresholds (bps): one pass for all."""
    if not thresholds:
        return {}
    window, basis = cfg.move_window, cfg.basis
    rows = quotes.where(F.col("sym").isin(list(thresholds))).select("sym", "recv_us", "seq", "event_us", "mid")
    fired = K.fold(rows, ["sym"], ["recv_us", "seq"], ["event_us", "mid"], lambda sym: K.several([b / 1e4 for b in thresholds[sym]], window, basis), {"fired": "long"}, ("event_us", window))
    most = max(map(len, thresholds.values()))
    counts = fired.groupBy("sym").agg(*[F.sum(F.shiftright("fired", i).bitwiseAND(F.lit(1))).alias(f"n{i}") for i in range(most)])
    found = {r["sym"]: [r[f"n{i}"] for i in range(most)] for r in counts.collect()}  # a row for each root
    return {sym: found.get(sym, [0] * most)[: len(b)] for sym, b in thresholds.items()}


def calibrate(quotes: DataFrame, cfg: Config) -> DataFrame:
    """(root, bps, unit, floored, rate, span_hours, n) per symbol root.

    All roots are searched side by side, each pass over the data settling several halvings for all of them; series are
    folded in pieces and never held. Only thresholds and counts, some for each root, are on the driver. A root whose
    ticks have no span is not searched: its bar is its unit, its rate null.
    """
    spark = quotes.sparkSession
    units = {r["sym"]: r for r in unit_bps(quotes, cfg).collect()}
    hours = {sym: r["span_hours"] for sym, r in units.items() if r["span_hours"] > 0}
    open_, asked, bars = {}, {}, {sym: r["unit"] for sym, r in units.items()}
    for sym in hours:
        open_[sym] = solver(cfg.recal_rate, units[sym]["unit"])
        asked[sym] = next(open_[sym])
    while asked:
        counts, answers = move_rates(quotes, asked, cfg), {}
        for sym, n in counts.items():
            try:
                answers[sym] = open_[sym].send([x / hours[sym] for x in n])
            except StopIteration as end:
                bars[sym] = end.value
        asked = answers
    last = move_rates(quotes, {sym: [bars[sym]] for sym in hours}, cfg)
    rows = [(sym, float(bars[sym]), float(r["unit"]), bool(bars[sym] <= r["unit"]), last[sym][0] / hours[sym] if sym in hours else None, float(r["span_hours"]), r["n"]) for sym, r in sorted(units.items())]
    return spark.createDataFrame(rows, "root string, bps double, unit double, floored boolean, rate double, span_hours double, n long")


def gate(n: Column, span_hours: Column, bps: Column, floored: Column, cfg: Config) -> Column:
    """First rule that applies."""
    return (
        F.when(n.isNull() | (n == 0), "SKIP_NODATA")
        .when((n < cfg.recal_min_ticks) | (span_hours < cfg.recal_min_hours), "SKIP_THIN")
        .when(~bps.between(cfg.recal_low, cfg.recal_high), "SKIP_BOUNDS")
        .when(floored, "OK_FLOORED")
        .otherwise("OK")
    )


def merged(current: DataFrame, solved: DataFrame, cfg: Config) -> DataFrame:
    """(root, bps, status): accepted results, to three decimals, over the thresholds in force."""
    s = solved.withColumn("status", gate(F.col("n"), F.col("span_hours"), F.col("bps"), F.col("floored"), cfg)).select("root", F.round("bps", 3).alias("new"), "status")
    both = current.select("root", F.col("bps").alias("old")).join(s, "root", "full_outer")
    ok = F.coalesce(F.col("status").startswith("OK"), F.lit(False))
    return both.select("root", F.when(ok, F.col("new")).otherwise(F.col("old")).alias("bps"), F.coalesce("status", F.lit("SKIP_NODATA")).alias("status")).where("bps IS NOT NULL")


def reference_quotes(book: DataFrame, cfg: Config, venue: str, hours: float) -> DataFrame:
    """Valid quotes of known symbols of one venue over the last hours of its receive times."""
    mine = book.where(F.col("venue") == venue)
    last = mine.agg((F.max("recv_us") - int(hours * HOUR)).alias("_lo"))  # one row
    recent = mine.join(F.broadcast(last)).where(F.col("recv_us") >= F.col("_lo")).drop("_lo")
    known = recent.where(E.valid_book(F.col("bid"), F.col("ask")))
    if cfg.symbols:
        known = known.withColumn("sym", E.canonical(F.col("sym"), cfg.symbols)).where(F.col("sym").isin(sorted(set(cfg.symbols.values()))))
    return known.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def run(book: DataFrame, current: DataFrame, cfg: Config, venue: str, hours: float = 3.0, apply: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """One recalibration: (root, cur_bps, new_bps, rate, floored, n, span_hours, status) of every known root.

    Without ``apply`` nothing changes (a dry run). With it, and if a root passed the gates, it gets the thresholds to be
    in force: those that passed, to three decimals, over the current ones.
    """
    solved = calibrate(reference_quotes(book, cfg, venue, hours), cfg)
    result = current.select("root", F.col("bps").alias("cur")).join(solved, "root", "full_outer")
    status = gate(F.col("n"), F.col("span_hours"), F.col("bps"), F.col("floored"), cfg)
    result = result.select("root", F.coalesce("cur", F.lit(cfg.threshold_bps)).alias("cur_bps"), F.col("bps").alias("new_bps"), "rate", "floored", F.coalesce("n", F.lit(0)).alias("n"), "span_hours", status.alias("status"))
    if apply is not None and not result.where(F.col("status").startswith("OK")).isEmpty():
        apply(merged(current, solved, cfg).select("root", "bps"))
    log.info("recalibration %s", "applied" if apply is not None else "dry run")
    return result


class Schedule:
    """Runs when due: at once at first, then every interval; the next time is set before a run, so a long one adds nothing."""

    def __init__(self, every: float, clock: Callable[[], float]):
        self.every, self.clock, self.next, self.runs = every, clock, clock(), 0

    def poll(self, job: Callable[[], object]) -> object | None:
        now = self.clock()
        if now < self.next:
            return None
        self.next = now + self.every
        self.runs += 1
        try:
            return job()
        except Exception:
            log.exception("recalibration failed")
            return None
