"""Directed co-movement of legs: band counts without a band join, base-rate correction, pair statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs as E
from ..functions.stats import poisson_tail
from ..schema import LEG

PAIR = ["sym", "direction", "lead_venue", "lead_inst", "follow_venue", "follow_inst"]
#: Microseconds summed over matches outgrow 64 bits from some 10^7 matches on.
WIDE = "decimal(38,0)"


def leg_pairs(moves: DataFrame, mode: str) -> DataFrame:
    """All ordered comparable leg pairs of a symbol and direction, with both legs' move counts."""
    legs = moves.groupBy(*LEG, "direction").agg(F.count("*").alias("n"))
    a = legs.select("sym", "direction", F.col("venue").alias("lead_venue"), F.col("inst").alias("lead_inst"), F.col("n").alias("n_lead"))
    b = legs.select("sym", "direction", F.col("venue").alias("follow_venue"), F.col("inst").alias("follow_inst"), F.col("n").alias("n_follow"))
    return a.join(b, ["sym", "direction"]).where(E.comparable(mode, F.col("lead_venue"), F.col("lead_inst"), F.col("follow_venue"), F.col("follow_inst")))


def pair_counts(moves: DataFrame, pairs: DataFrame, follow: int, dead: int) -> DataFrame:
    """(pair, obs, lag_us): for each follow move the lead moves ``dead`` to ``follow`` earlier, both inclusive.

    Leads and follows of a pair are one tagged series, moves of the same time one row; the leads behind each follow are
    the difference of two running sums, so the work is linear where a join's matches would be quadratic. Time is cut into
    buckets of a few windows, leads reaching into the next bucket, so no pair's series is ever one task. ``t`` counts
    from the bucket's start, and what grows with the matches is summed in 38 digits.
    """
    if dead > follow:
        return pairs.select(*PAIR).withColumn("obs", F.lit(0).cast("long")).withColumn("lag_us", F.lit(0).cast(WIDE))
    width = 4 * max(follow, 1)
    keys = pairs.select(*PAIR)
    times = moves.groupBy(*LEG, "direction", "t").agg(F.count("*").alias("n"))
    lead = times.select("sym", "direction", F.col("venue").alias("lead_venue"), F.col("inst").alias("lead_inst"), "t", "n").join(keys, ["sym", "direction", "lead_venue", "lead_inst"])
    lead = lead.select(*PAIR, "t", F.col("n").alias("leads"), F.lit(0).cast("long").alias("follows"), F.explode(F.sequence(F.floor((F.col("t") + dead) / width), F.floor((F.col("t") + follow) / width))).alias("bucket"))
    foll = times.select("sym", "direction", F.col("venue").alias("follow_venue"), F.col("inst").alias("follow_inst"), "t", "n").join(keys, ["sym", "direction", "follow_venue", "follow_inst"])
    foll = foll.select(*PAIR, "t", F.lit(0).cast("long").alias("leads"), F.col("n").alias("follows"), F.floor(F.col("t") / width).alias("bucket"))
    series = lead.unionByName(foll).withColumn("t", F.col("t") - F.col("bucket") * width)
    w = Window.partitionBy(*PAIR, "bucket").orderBy("t")
    near, far = w.rangeBetween(Window.unboundedPreceding, -dead), w.rangeBetween(Window.unboundedPreceding, -follow - 1)
    moment = F.col("leads").cast(WIDE) * F.col("t")

    def between(value):
        return F.coalesce(F.sum(value).over(near), F.lit(0)) - F.coalesce(F.sum(value).over(far), F.lit(0))

    # follows count leads only; their own rows add nothing to the sums
    counted = series.withColumn("c", between(F.col("leads"))).withColumn("s", between(moment)).where("follows > 0")
    lag = F.col("follows").cast(WIDE) * (F.col("c").cast(WIDE) * F.col("t") - F.col("s")).cast(WIDE)
    return counted.groupBy(*PAIR).agg(F.sum(F.col("follows") * F.col("c")).alias("obs"), F.sum(lag.cast(WIDE)).cast(WIDE).alias("lag_us"))


def pair_matrix(moves: DataFrame, cfg: Config, lo: int | None, end: int | None, dead: int | None = None) -> DataFrame:
    """The directed pair matrix of moves received within [lo, end]: pairs without a match are rows too.

    The expected count is that of independent legs over the span of all moves in the window (all symbols together).
    A dead band above the follow window leaves nothing to match and nothing expected.
    """
    dead = cfg.dead_band if dead is None else dead
    rows = moves
    if lo is not None:
        rows = rows.where(F.col("recv_us") >= lo)
    if end is not None:
        rows = rows.where(F.col("recv_us") <= end)
    rows = rows.select(*LEG, "direction", E.lag_clock(cfg.lag_clock).alias("clk"))
    span = rows.agg(F.min("clk").alias("t0"), F.greatest(F.lit(1), F.max("clk") - F.min("clk")).alias("span"))  # one row
    based = rows.join(F.broadcast(span)).select(*LEG, "direction", (F.col("clk") - F.col("t0")).alias("t"))
    pairs = leg_pairs(rows, cfg.pair_mode)
    width = max(0, cfg.follow_window - dead)
    counts = pair_counts(based, pairs, cfg.follow_window, dead)
    full = pairs.join(counts, PAIR, "left").join(F.broadcast(span.select("span")))
    full = full.withColumn("obs", F.coalesce("obs", F.lit(0)).cast("long")).withColumn("lag_us", F.coalesce("lag_us", F.lit(0)).cast("double"))
    full = full.withColumn("expected", F.col("n_follow") * (F.col("n_lead") / F.col("span")) * width)
    return full.select(
        *PAIR, "n_lead", "n_follow", "obs",
        (F.col("obs") - F.col("lag_us") / cfg.follow_window).alias("obs_k"), "expected", (F.col("obs") - F.col("expected")).alias("excess"),
        (F.col("lag_us") / 1000).alias("lag_sum_ms"), (F.try_divide(F.col("lag_us"), F.col("obs")) / 1000).alias("avg_lag_ms"),
        poisson_tail(F.col("obs"), F.col("expected")).alias("p_value"),
    )
