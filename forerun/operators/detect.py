"""Move detectors: windows where a frame suffices, the fold kernel where the frame depends on the last firing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs as E
from ..schema import LEG
from . import fold as K
from .relational import as_of


def _direction(sign: Column) -> Column:
    return F.when(sign > 0, "up").otherwise("down")


def tickwise(quotes: DataFrame, cfg: Config) -> DataFrame:
    """Moves of one tick to the next, relative, in basis points: the engine's hot-path detector."""
    # rows that share their number are ordered by value, or their order would be the shuffle's
    before = F.lag("mid").over(Window.partitionBy(*LEG).orderBy("recv_us", "seq", "mid"))
    bps = F.try_divide(10000 * (F.col("mid") - F.col("_prev")), F.col("_prev"))
    thr = E.threshold(F.col("sym"), cfg.threshold_by_sym, cfg.threshold_bps, cfg.threshold_mult)
    rows = quotes.withColumn("_prev", before).withColumn("move_bps", bps).where(F.abs("move_bps") >= thr)
    return rows.select(*LEG, "event_us", "recv_us", "seq", "mid", "move_bps", _direction(F.col("move_bps")).alias("direction"))


def tickwise_basis(series: DataFrame, keys: list[str], time: str, seq: str, value: str, thr: float, basis: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time, seq)
    d = E.change(basis, F.col("_prev"), F.col(value))
    return series.withColumn("_prev", F.lag(value).over(w)).withColumn("size", d).where(F.abs("size") >= thr).select(*keys, time, seq, F.signum("size").cast("int").alias("dir"), F.abs("size").alias("size"))


def windowed(series: DataFrame, keys: list[str], time: str, seq: str, value: str, thr: float, window: int, basis: str) -> DataFrame:
    """Change against the last value at or before the window's start; only the first of a run of equal signs fires."""
    w = Window.partitionBy(*keys).orderBy(time, seq)
    base = as_of(series, keys, time, seq, value, window, "_base")
    d = E.change(basis, F.col("_base"), F.col(value))
    signed = base.withColumn("_d", d).withColumn("dir", F.when(F.abs("_d") >= thr, F.signum("_d").cast("int")).otherwise(0))
    return signed.withColumn("_before", F.coalesce(F.lag("dir").over(w), F.lit(0))).where("dir <> 0 AND dir <> _before").select(*keys, time, seq, "dir", F.abs("_d").alias("size"))


def runs(signs: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """Starts of runs of equal non-zero ``dir``."""
    w = Window.partitionBy(*keys).orderBy(time, seq)
    return signs.withColumn("_before", F.coalesce(F.lag("dir").over(w), F.lit(0))).where("dir <> 0 AND dir <> _before").drop("_before")


_FOLDS = {
    "cumulative": lambda thr, window, basis: K.cumulative(thr, basis),
    "cumstale": lambda thr, window, basis: K.cumstale(thr, window, basis),
    "winreset": lambda thr, window, basis: K.winreset(thr, window, basis),
}


def folded(series: DataFrame, mode: str, keys: list[str], time: str, seq: str, value: str, thr: float, window: int, basis: str) -> DataFrame:
    """(keys, time, seq, dir, size) of the firings of a resettable detector."""
    make = _FOLDS[mode]
    rows = series.where(F.col(value).isNotNull())
    return K.fold(rows, keys, [time, seq], [time, value], lambda *key: make(thr, window, basis), {"dir": "int", "size": "double"}, _quiet(mode, time, window))


def _quiet(mode: str, time: str, window: int) -> tuple[str, int] | None:
    """The silence after which a detector starts anew; the cumulative one never does."""
    return None if mode == "cumulative" else (time, window)


def detect(series: DataFrame, mode: str, keys: list[str], time: str, seq: str, value: str, thr: float, window: int, basis: str) -> DataFrame:
    """Dispatch by mode, one output for all."""
    if mode == "tickwise":
        return tickwise_basis(series, keys, time, seq, value, thr, basis)
    if mode == "windowed":
        return windowed(series, keys, time, seq, value, thr, window, basis)
    if mode in _FOLDS:
        return folded(series, mode, keys, time, seq, value, thr, window, basis)
    raise ValueError(f"unknown detector mode: {mode}")


def imbalance_bars(trades: DataFrame, cfg: Config) -> DataFrame:
    """(leg, event_us, seq, dir) of closed bars of signed notional, in event order; trades of one number by their notional."""
    by, default = cfg.bar_by_sym, cfg.bar_default
    return K.fold(trades, LEG, ["event_us", "seq", "signed"], ["signed"], lambda sym, *_: K.imbalance(by.get(sym, default)), {"dir": "int"}).drop("signed")


def quote_moves(quotes: DataFrame, cfg: Config) -> DataFrame:
    """Moves of valid quotes in the configured mode, with both clocks and the signed size in basis points."""
    if cfg.mode == "tickwise":
        return tickwise(quotes, cfg)
    by, default, mult = cfg.threshold_by_sym, cfg.threshold_bps, cfg.threshold_mult
    make, window, basis = _FOLDS[cfg.mode], cfg.move_window, cfg.basis
    # the detector's clock is the event time even where it is not monotonic in arrival order
    fired = K.fold(quotes, LEG, ["recv_us", "seq"], ["event_us", "mid"], lambda sym, *_: _with_row(make(mult * by.get(sym, default) / 1e4, window, basis)), {"event_us": "long", "mid": "double", "dir": "int", "size": "double"}, _quiet(cfg.mode, "event_us", window))
    return fired.select(*LEG, "event_us", "recv_us", "seq", "mid", (F.col("dir") * F.col("size") * 10000).alias("move_bps"), _direction(F.col("dir")).alias("direction"))


def trade_moves(trades: DataFrame, cfg: Config) -> DataFrame:
    """Moves of trade prices: winreset on logarithmic returns in receive order, with a bar and a state of its own."""
    fired = K.fold(trades, LEG, ["recv_us", "seq"], ["event_us", "px"], lambda *_: _with_row(K.winreset(cfg.trade_bps / 1e4, cfg.move_window, "log")), {"event_us": "long", "mid": "double", "dir": "int", "size": "double"}, _quiet("winreset", "event_us", cfg.move_window))
    return fired.select(*LEG, "event_us", "recv_us", "seq", "mid", (F.col("dir") * F.col("size") * 10000).alias("move_bps"), _direction(F.col("dir")).alias("direction"))


def _with_row(step):
    def run(t, v):
        got = step(t, v)
        return None if got is None else (t, v, *got)

    return run
