"""Sinks: appended event files, periodic snapshots, replaced tables, the snapshot API and its text view."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("forerun")


def append_events(events: DataFrame, path: str) -> None:
    """One CSV row per event, with a header in each file."""
    events.write.mode("append").option("header", True).csv(path)


def snapshot_table(table: DataFrame, path: str, as_of_us: int) -> None:
    table.withColumn("snapshot_us", F.lit(as_of_us).cast("long")).write.mode("append").parquet(path)


def replace_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def retained(table: DataFrame, time: str, now: int, keep: int) -> DataFrame:
    return table.where(F.col(time) >= now - keep)


def write_thresholds(merged: DataFrame, path: str) -> None:
    """The merged threshold table, one small file, three decimals."""
    merged.select("root", F.round("bps", 3).alias("bps")).coalesce(1).write.mode("overwrite").json(path)
    log.info("thresholds written to %s", path)


def recent_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), "sym", "venue", "inst", "alert_type", "msg").limit(n)


def inventory(tables: dict[str, DataFrame | None]) -> dict[str, int | None]:
    """Row counts by table, None where a table is absent."""
    return {name: None if t is None else t.count() for name, t in tables.items()}


#: Tables whose rows the snapshot counts.
COUNTED = ["quotes", "moves", "events", "alerts", "legs", "pairs", "score", "health", "session", "flow_bars", "trade_moves", "session_flow", "session_price"]


def snapshot(tables: dict[str, DataFrame | None], scores: dict[str, DataFrame], health: DataFrame, alerts: DataFrame, fresh: DataFrame | None = None, now_us: int | None = None, started_ms: int | None = None, memory: dict | None = None) -> dict:
    """Everything a dashboard shows: counts, score tables (scored legs; ``score30`` whole), health, the latest alerts,
    each leg's last tick, and how long and in what memory the application runs."""
    kept = {k: v if k == "score30" else v.where(F.col("score").isNotNull()) for k, v in scores.items()}
    uptime = None if now_us is None or started_ms is None else max(0, now_us // 1000 - started_ms)
    return {"counts": inventory(tables), "health": health, "alerts": recent_alerts(alerts), "fresh": fresh, "now_us": now_us, "started_ms": started_ms, "uptime_ms": uptime, "memory": memory} | kept


def age_text(ms: float | None) -> str:
    if ms is None or ms != ms:
        return "-"
    for below, unit, digits, name in ((1e3, 1, 0, "ms"), (6e4, 1e3, 1, "s"), (3.6e6, 6e4, 1, "m")):
        if ms < below:
            return f"{ms / unit:.{digits}f}{name}"
    return f"{ms / 3.6e6:.1f}h"


def uptime_text(ms: int | None) -> str:
    if ms is None:
        return "-"
    seconds = int(ms) // 1000
    return f"{seconds // 3600}h {seconds // 60 % 60}m {seconds % 60}s"


def count_text(n: float | None, compact: bool = False) -> str:
    """With thousands separators, or from ten thousand on in short."""
    if n is None or n != n:
        return "-"
    if compact and n >= 10_000:
        return f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}k"
    return f"{int(n):,}"


def render(snap: dict, limit: int = 10) -> str:
    """The snapshot as text: uptime, counts, strongest legs first, health by venue, stalest legs, alerts."""
    lines = ["up " + uptime_text(snap.get("uptime_ms")), "rows: " + ", ".join(f"{k}={count_text(v, compact=True)}" for k, v in snap["counts"].items())]
    for name, frame in snap.items():
        if isinstance(frame, DataFrame) and "score" in frame.columns:
            top = frame.where(F.col("score").isNotNull()).orderBy(F.desc(F.abs("score")), "sym", "venue", "inst").limit(limit).collect()
            lines += [f"[{name}]"] + [f"{r['sym']} {r['venue']}/{r['inst']} {r['score']:+.3f} p={r['p_value']:.3g}" for r in top]
    if "ticks_per_min" in snap["health"].columns:
        by_venue = snap["health"].groupBy("venue").agg(F.sum("ticks_per_min").alias("rate"), F.max("last_tick_age_ms").alias("age"), F.max("invalid_share").alias("invalid")).orderBy("venue")
        lines += ["[health]"] + [f"{r['venue']} {r['rate']:.1f}/min age {age_text(r['age'])} invalid {100 * (r['invalid'] or 0):.1f}%" for r in by_venue.collect()]
    if snap.get("fresh") is not None:
        lines += ["[legs]"] + [f"{r['sym']} {r['venue']}/{r['inst']} {age_text(r['age_ms'])}" for r in snap["fresh"].orderBy(F.desc_nulls_last("age_ms"), "sym", "venue", "inst").limit(limit).collect()]
    lines += ["[alerts]"] + [f"{r['ts']} {r['alert_type']} {r['sym'] or '*'} {r['venue']}/{r['inst']}" for r in snap["alerts"].collect()]
    return "\n".join(lines)


class HighWater:
    """The latest time judged, kept in a small file of the shared storage between runs, so a lead is judged once."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> int | None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return None
        return self.spark.read.schema("judged_us long").json(self.path).agg(F.max("judged_us")).first()[0]

    def write(self, judged_us: int) -> None:
        self.spark.createDataFrame([(int(judged_us),)], "judged_us long").coalesce(1).write.mode("overwrite").json(self.path)
