"""Clock skew, regimes, feed health and alerts, each as of an explicit time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs as E
from ..schema import LEG
from .relational import absent_from, nearest_rank


def skew_stats(samples: DataFrame, cfg: Config) -> DataFrame:
    """(venue, inst, offset_us, jitter_us, n) over the last minutes of the samples (venue, inst, recv_us, diff_us).

    A difference of 0 marks a fallback time and is left out; too few samples give no row.
    """
    last = samples.agg((F.max("recv_us") - cfg.skew_window).alias("_lo"))
    recent = samples.join(F.broadcast(last)).where((F.col("recv_us") >= F.col("_lo")) & (F.col("diff_us") != 0))
    ranks = nearest_rank(recent, ["venue", "inst"], "diff_us", {"lo": cfg.skew_low, "hi": cfg.skew_high})
    return ranks.where(F.col("n") >= cfg.skew_min).select("venue", "inst", F.col("lo").alias("offset_us"), (F.col("hi") - F.col("lo")).alias("jitter_us"), "n")


def dead_band(stats: DataFrame, cfg: Config) -> DataFrame:
    """One row: the measured band, and the one in force (fixed: the floor; auto: the larger of both).

    Where no leg has samples enough, nothing is measured and the floor stands for it.
    """
    measured = F.coalesce(F.round(F.sqrt(F.lit(2.0)) * F.max("jitter_us")), F.lit(cfg.dead_band)).cast("long")
    force = F.greatest(F.lit(cfg.dead_band), F.col("measured_us")) if cfg.dead_band_mode == "auto" else F.lit(cfg.dead_band)
    return stats.agg(measured.alias("measured_us")).select("measured_us", force.cast("long").alias("dead_band_us"))


def calibrated(moves: DataFrame, stats: DataFrame) -> DataFrame:
    return moves.join(stats.select("venue", "inst", "offset_us"), ["venue", "inst"], "left").withColumn("cal_us", E.lag_clock("cal"))


def realised_vol(quotes: DataFrame) -> DataFrame:
    before = F.lag("mid").over(Window.partitionBy(*LEG).orderBy("recv_us", "seq"))
    bps = F.try_divide(10000 * (F.col("mid") - F.col("_prev")), F.col("_prev"))
    return quotes.withColumn("_prev", before).withColumn("_bps", bps).groupBy(*LEG).agg(F.sqrt(F.sum(F.col("_bps") * F.col("_bps"))).alias("vol_bps"))


def regimes(quotes: DataFrame, cfg: Config, end: int, boundaries: DataFrame | None = None) -> DataFrame:
    """Spread and volatility bucket of each leg with a quote in the window ending at ``end`` (both ends inclusive)."""
    w = quotes.where((F.col("recv_us") >= end - cfg.regime_window) & (F.col("recv_us") <= end))
    spread = F.try_divide(10000 * (F.col("q.ask") - F.col("q.bid")), F.col("q.mid"))
    last = w.groupBy(*LEG).agg(F.max_by(F.struct("bid", "ask", "mid"), F.struct("recv_us", "seq")).alias("q")).select(*LEG, spread.alias("spread_bps"))
    rows = last.join(realised_vol(w), LEG, "left").withColumn("vol_bps", F.coalesce("vol_bps", F.lit(0.0)))
    if boundaries is None:
        rows = rows.select("*", *[F.lit(None).cast("double").alias(c) for c in ("spread_tight", "spread_wide", "vol_low")])
    else:
        rows = rows.join(boundaries, LEG, "left")
    tight, wide, low = (F.coalesce(F.col(c), F.lit(v)) for c, v in (("spread_tight", cfg.tight_bps), ("spread_wide", cfg.wide_bps), ("vol_low", cfg.low_vol_bps)))
    spread_bucket = F.when(F.col("spread_bps") <= tight, "tight").when(F.col("spread_bps") <= wide, "normal").otherwise("wide")
    vol_bucket = F.when(F.col("vol_bps") <= low, "low").otherwise("high")
    return rows.select(*LEG, "spread_bps", "vol_bps", F.concat_ws("_", spread_bucket, vol_bucket).alias("regime_bucket"))


def stale_followers(moves: DataFrame, legs: DataFrame, cfg: Config, lo: int | None, end: int) -> DataFrame:
    """Comparable siblings of mature leads that made no move of that direction within the window around the lead.

    The reaction test is an anti join on leg, direction and time bucket with the band as residual.
    """
    s = cfg.stale_window
    lead = moves.where(F.col("recv_us") <= end - s)
    lead = lead if lo is None else lead.where(F.col("recv_us") > lo)
    lead = lead.select("sym", "direction", F.col("venue").alias("lead_venue"), F.col("inst").alias("lead_inst"), F.col("recv_us").alias("lead_us"))
    siblings = legs.select("sym", "venue", "inst").distinct()
    cand = lead.join(siblings, "sym").where(E.comparable(cfg.pair_mode, F.col("lead_venue"), F.col("lead_inst"), F.col("venue"), F.col("inst")))
    width = max(s, 1)
    # a reaction is within one bucket of the lead's; it is listed in its own and both neighbours
    moved = moves.select("sym", "venue", "inst", "direction", F.col("recv_us").alias("m_us"), F.explode(F.array(*[F.floor(F.col("recv_us") / width) + i for i in (-1, 0, 1)])).alias("bucket"))
    cand = cand.withColumn("bucket", F.floor(F.col("lead_us") / width))
    c, m = cand.alias("c"), moved.alias("m")
    same = [F.col(f"c.{k}") == F.col(f"m.{k}") for k in ("sym", "venue", "inst", "direction", "bucket")]
    near = F.abs(F.col("m.m_us") - F.col("c.lead_us")) <= s
    stale = c.join(m, same[0] & same[1] & same[2] & same[3] & same[4] & near, "left_anti")
    msg = F.concat(F.col("lead_venue"), F.lit("/"), F.col("lead_inst"), F.lit("_"), F.col("direction"))
    return stale.select(F.lit(end).cast("long").alias("ts"), "sym", "venue", "inst", F.lit("stale").alias("alert_type"), msg.alias("msg"))


def new_alerts(found: DataFrame, sent: DataFrame, cfg: Config, end: int) -> DataFrame:
    """Distinct alerts whose leg, type and message were not sent within the alert cooldown."""
    recent = sent.where(F.col("ts") > end - cfg.alert_cooldown)
    return absent_from(found.distinct(), recent, ["sym", "venue", "inst", "alert_type", "msg"])


def health_counts(rows: DataFrame, ok: str = "valid") -> DataFrame:
    """Accepted and rejected rows of each leg in one pass."""
    return rows.groupBy(*LEG).agg(F.count_if(F.col(ok)).alias("n_accepted"), F.count_if(~F.col(ok)).alias("n_rejected"))


def feed_health(rows: DataFrame, samples: DataFrame, cfg: Config, now: int) -> DataFrame:
    """One row per leg with an accepted tick up to ``now``; ``rows`` carry ``valid``; no ticks in the window: null share."""
    upto = rows.where(F.col("recv_us") <= now)
    legs = upto.where("valid").groupBy(*LEG).agg(F.max("recv_us").alias("last_us"))
    counts = health_counts(upto.where(F.col("recv_us") >= now - cfg.health_window))
    recent = samples.where(F.col("recv_us") <= now)
    share = recent.join(F.broadcast(recent.agg((F.max("recv_us") - cfg.skew_window).alias("_lo")))).where(F.col("recv_us") >= F.col("_lo"))
    share = share.groupBy("venue", "inst").agg(F.avg(F.when(F.col("diff_us") == 0, 1.0).otherwise(0.0)).alias("fallback_share"), F.count("*").alias("n_skew"))
    stats = skew_stats(recent, cfg).drop("n")
    h = legs.join(counts, LEG, "left").join(share, ["venue", "inst"], "left").join(stats, ["venue", "inst"], "left")
    a, r = F.coalesce("n_accepted", F.lit(0)), F.coalesce("n_rejected", F.lit(0))
    return h.select(
        *LEG, ((F.lit(now) - F.col("last_us")) / 1000).alias("last_tick_age_ms"), (a / (cfg.health_window / 60_000_000)).alias("ticks_per_min"), a.alias("n_accepted"), r.alias("n_rejected"),
        F.try_divide(r.cast("double"), (a + r).cast("double")).alias("invalid_share"), (F.col("offset_us") / 1000).alias("one_way_floor_ms"), (F.col("jitter_us") / 1000).alias("one_way_jitter_ms"), "fallback_share", F.coalesce("n_skew", F.lit(0)).alias("n_skew"),
    )


def health_conditions(health: DataFrame, cfg: Config) -> DataFrame:
    """Active conditions; a fallback clock is one per venue and instrument, with a null symbol."""
    quiet = health.where(F.col("last_tick_age_ms") > cfg.quiet / 1000).select(*LEG, F.lit("feedstale").alias("alert_type"))
    bad = health.where((F.col("invalid_share") > cfg.invalid_share) & (F.col("n_accepted") + F.col("n_rejected") >= cfg.invalid_min)).select(*LEG, F.lit("invalid").alias("alert_type"))
    clock = health.where((F.col("fallback_share") > cfg.fallback_share) & (F.col("n_skew") >= cfg.skew_min)).select(F.lit(None).cast("string").alias("sym"), "venue", "inst", F.lit("clockfallback").alias("alert_type")).distinct()
    return quiet.unionByName(bad).unionByName(clock)


def edges(active: DataFrame, times: DataFrame) -> DataFrame:
    """(ts, key, edge) of conditions over evaluation times: onset where the evaluation before had it not, recovery after.

    ``active`` has ts and the key of each condition at each evaluation; ``times`` every evaluation time.
    """
    key = ["sym", "venue", "inst", "alert_type"]
    seq = times.select("ts").distinct().withColumn("no", F.row_number().over(Window.orderBy("ts")))  # as many rows as evaluations
    rows = active.select("ts", *key).distinct().join(seq, "ts")
    w = Window.partitionBy(*key).orderBy("no")
    marked = rows.withColumn("before", F.lag("no").over(w)).withColumn("after", F.lead("no").over(w))
    onset = marked.where("before IS NULL OR before < no - 1").select("ts", *key, F.lit("onset").alias("edge"))
    over = marked.where("after IS NULL OR after > no + 1").select((F.col("no") + 1).alias("no"), *key).join(seq, "no").select("ts", *key, F.lit("recovery").alias("edge"))
    return onset.unionByName(over)


def leg_freshness(quotes: DataFrame, now: int) -> DataFrame:
    last = quotes.groupBy(*LEG).agg(F.max_by(F.struct("recv_us", "mid"), F.struct("recv_us", "seq")).alias("q"))
    return last.select(*LEG, ((F.lit(now) - F.col("q.recv_us")) / 1000).alias("age_ms"), F.col("q.mid").alias("mid"))


def silent_legs(quotes: DataFrame, times: DataFrame, gap: int) -> DataFrame:
    """(ts, leg) of the legs without a quote within ``gap`` up to each evaluation time; buckets of ``gap`` are joined."""
    q = quotes.select(*LEG, "recv_us", F.floor(F.col("recv_us") / gap).alias("bucket"))
    legs = quotes.select(*LEG).distinct().join(F.broadcast(times.select("ts")))  # legs by evaluation times: both small
    near = legs.withColumn("bucket", F.explode(F.array(F.floor(F.col("ts") / gap), F.floor(F.col("ts") / gap) - 1)))
    heard = near.join(q, [*LEG, "bucket"]).where((F.col("recv_us") <= F.col("ts")) & (F.col("recv_us") >= F.col("ts") - gap)).select("ts", *LEG).distinct()
    return legs.join(heard, ["ts", *LEG], "left_anti")


def uptime_ms(spark, legs: DataFrame | None, now_ms: int) -> int:
    """Milliseconds since the application began; where that is unknown, since the earliest tick of a leg, else 0."""
    began = getattr(spark.sparkContext, "startTime", None)
    if began is None and legs is not None:
        first = legs.agg(F.min("recv_us")).first()[0]
        began = None if first is None else first // 1000
    return 0 if began is None else max(0, now_ms - int(began))


def memory(spark) -> dict[str, int]:
    """Bytes that executors may store, those that are free, and how many executors there are."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    pairs = [(t._1(), t._2()) for t in (v for v in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status).values())]
    return {"storage_bytes": sum(int(p[0]) for p in pairs), "free_bytes": sum(int(p[1]) for p in pairs), "executors": len(pairs)}


def venue_rollup(health: DataFrame) -> DataFrame:
    return health.groupBy("venue").agg(F.sum("ticks_per_min").alias("ticks_per_min"), F.max("last_tick_age_ms").alias("max_age_ms"), F.max("invalid_share").alias("max_invalid_share"))


def status(connected: bool, max_age_ms: float | None, recent_types: list[str]) -> str:
    """Traffic light of the snapshot: quotes' age first, then how many of the recent alerts are not ``stale``."""
    if not connected:
        return "DISCONNECTED"
    if max_age_ms is None:
        return "WARMING"
    if max_age_ms > 300_000 or sum(t != "stale" for t in recent_types) > 10:
        return "DEGRADED"
    return "WARMING" if max_age_ms > 30_000 else "HEALTHY"


