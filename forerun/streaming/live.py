"""Structured Streaming: detectors with carried state, and the batch plans inside foreachBatch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import HOUR, Config
from ..operators.fold import change
from ..operators.score import session_score, windowed_score
from ..schema import LEG, MOVE


@dataclass
class LegState:
    """What a leg carries from batch to batch, in plain values.

    Every mode keeps the last value and the base warm, so a stream that starts again in another mode goes on from there.
    """

    last: float | None = None
    base: float | None = None
    base_at: int | None = None
    low: list[list] = field(default_factory=list)  # the window's rising minima and falling maxima (time, value)
    high: list[list] = field(default_factory=list)

    def tickwise(self, t: int, v: float, thr: float, window: int, basis: str):
        """Relative whatever the basis, in the sign of the change."""
        before, self.last, self.base, self.base_at = self.last, v, v, t
        if before is None or before == 0 or abs(v - before) / abs(before) < thr:
            return None
        return (v - before) / before

    def cumstale(self, t: int, v: float, thr: float, window: int, basis: str):
        self.last = v
        if self.base is None or t - self.base_at > window:
            self.base, self.base_at = v, t
            return None
        moved = change(basis, self.base, v)
        if abs(moved) < thr:
            return None
        self.base, self.base_at = v, t
        return moved

    def winreset(self, t: int, v: float, thr: float, window: int, basis: str):
        self.last, self.base, self.base_at = v, v, t
        for held, over in ((self.low, lambda x: x >= v), (self.high, lambda x: x <= v)):
            gone = next((i for i, h in enumerate(held) if h[0] >= t - window), len(held))
            del held[:gone]
            while held and over(held[-1][1]):
                held.pop()
            held.append([t, v])
        up, down = change(basis, self.low[0][1], v), change(basis, self.high[0][1], v)
        moved = up if up >= thr else down if -down >= thr else None
        if moved is not None:
            self.low, self.high = [[t, v]], [[t, v]]
        return moved


def carried(rows: DataFrame, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Per leg, rows in ``order`` within a micro-batch and as they arrive across batches.

    ``step(key, state, row)`` gets the state (a dict, empty at first) and gives (state, an output row or None).
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = json.loads(state.get[0]) if state.exists else {}, []
        for row in pd.concat(list(frames)).sort_values(order).to_dict("records"):
            held, got = step(key, held, row)
            if got is not None:
                out.append((*key, *got))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*LEG).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def _moves(rows: DataFrame, value: str, mode: str, bar: Callable[[str], float], window: int, basis: str) -> DataFrame:
    if mode not in ("tickwise", "cumstale", "winreset"):
        raise ValueError(f"unknown streaming detector: {mode}")

    def step(key, held, row):
        state = LegState(**held)
        moved = getattr(state, mode)(int(row["event_us"]), float(row[value]), bar(key[0]), window, basis)
        got = None if moved is None else (int(row["event_us"]), int(row["recv_us"]), int(row["seq"]), float(row[value]), moved * 1e4, "up" if moved > 0 else "down")
        return asdict(state), got

    return carried(rows.select(*LEG, "event_us", "recv_us", "seq", value), ["recv_us", "seq"], step, MOVE)


def stream_moves(quotes: DataFrame, cfg: Config) -> DataFrame:
    """Moves of a stream of valid quotes (sym, venue, inst, event_us, recv_us, seq, mid) in the configured mode."""
    by, default, mult = cfg.threshold_by_sym, cfg.threshold_bps, cfg.threshold_mult
    return _moves(quotes, "mid", cfg.mode, lambda sym: mult * by.get(sym, default) / 1e4, cfg.move_window, cfg.basis)


def stream_trade_moves(trades: DataFrame, cfg: Config) -> DataFrame:
    """Moves of a stream of trade prices (leg, event_us, recv_us, seq, px): winreset, logarithmic."""
    return _moves(trades, "px", "winreset", lambda sym: cfg.trade_bps / 1e4, cfg.move_window, "log")


def stream_bars(trades: DataFrame, cfg: Config) -> DataFrame:
    """Imbalance bars of a stream of trades (leg, event_us, recv_us, seq, signed), in event order within a batch."""
    by, default = cfg.bar_by_sym, cfg.bar_default

    def step(key, held, row):
        total = held.get("total", 0.0) + float(row["signed"])
        if abs(total) < by.get(key[0], default):
            return {"total": total}, None
        return {"total": 0.0}, (int(row["event_us"]), int(row["recv_us"]), int(row["seq"]), "up" if total > 0 else "down")

    schema = "sym string, venue string, inst string, event_us long, recv_us long, seq long, direction string"
    return carried(trades.select(*LEG, "event_us", "recv_us", "seq", "signed"), ["event_us", "seq"], step, schema)


def on_batch(cfg: Config, history: str, sink: Callable[[str, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a stream of moves (``stream_moves``): keep them, rescore as of the batch's latest receive time.

    The history lies in folders by hour and epoch. A retried epoch replaces its own folders, only the session's hours
    are read, and hours before them are removed.
    """

    def run(moves: DataFrame, epoch: int) -> None:
        spark = moves.sparkSession
        hours = moves.withColumn("hour", F.floor(F.col("recv_us") / HOUR))
        for r in hours.groupBy("hour").agg(F.max("recv_us").alias("end")).orderBy("hour").collect():  # hours of one batch
            hours.where(F.col("hour") == r["hour"]).drop("hour").write.mode("overwrite").parquet(f"{history}/hour={r['hour']}/epoch={epoch}")
            end = r["end"]
            first = (end - cfg.session_window) // HOUR
            root = spark._jvm.org.apache.hadoop.fs.Path(history)
            fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
            there = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("hour=")}
        if hours.isEmpty():
            return
        for hour, path in there.items():
            if hour < first:
                fs.delete(path, True)
        kept = spark.read.schema(MOVE).option("basePath", history).parquet(*[str(p) for h, p in sorted(there.items()) if h >= first])
        sink("window", windowed_score(kept, cfg, end))
        sink("session", session_score(kept, cfg, end))

    return run


def watermarked_counts(quotes: DataFrame, late: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """Ticks per leg and minute of a stream, by receive time, dropping what comes later than the watermark."""
    timed = quotes.withColumn("recv_ts", F.timestamp_micros("recv_us")).withWatermark("recv_ts", late)
    return timed.groupBy(F.window("recv_ts", width), *LEG).agg(F.count("*").alias("n")).select(F.unix_micros(F.col("window.start")).alias("start_us"), *LEG, "n")
