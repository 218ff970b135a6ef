"""Leg leadership scores from the directed pair matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.stats import sign_test, wilson
from ..schema import LEG
from .pairs import pair_matrix
from .relational import lookup_join


def leg_scores(pairs: DataFrame, z: float) -> DataFrame:
    """One row per leg on either side of a pair; ratios are null where nothing was observed."""
    sides = []
    for side, other in (("lead", "led"), ("follow", "fol")):
        measures = [F.col(c).alias(f"{p}_{c}") if p == other else F.lit(0).cast(t).alias(f"{p}_{c}") for p in ("led", "fol") for c, t in (("excess", "double"), ("obs", "long"), ("obs_k", "double"))]
        sides.append(pairs.select("sym", F.col(f"{side}_venue").alias("venue"), F.col(f"{side}_inst").alias("inst"), *measures, (F.col("lag_sum_ms") if other == "led" else F.lit(0.0)).alias("lag")))
    # both sides in one aggregate: the union of legs needs no outer join
    legs = sides[0].unionByName(sides[1]).groupBy(*LEG).agg(*[F.sum(c).alias(c) for c in ("led_excess", "led_obs", "led_obs_k", "fol_excess", "fol_obs", "fol_obs_k", "lag")])
    n = F.col("led_obs") + F.col("fol_obs")
    lo, hi = wilson(F.col("led_obs"), n, z)
    return legs.select(
        *LEG, F.try_divide(F.col("led_excess") - F.col("fol_excess"), n.cast("double")).alias("score"), F.try_divide(F.col("led_obs_k") - F.col("fol_obs_k"), F.col("led_obs_k") + F.col("fol_obs_k")).alias("score_k"),
        F.try_divide(F.col("lag"), F.col("led_obs").cast("double")).alias("avg_lag_ms"), n.alias("n_events"), sign_test(F.col("led_obs"), n).alias("p_value"), (2 * lo - 1).alias("ci_low"), (2 * hi - 1).alias("ci_high"),
    )


def windowed_score(moves: DataFrame, cfg: Config, end: int) -> DataFrame:
    return leg_scores(pair_matrix(moves, cfg, end - cfg.score_window, end), cfg.z)


def session_score(moves: DataFrame, cfg: Config, end: int, dead: int | None = None) -> DataFrame:
    """Any history of moves scored over the session: quotes, trade prices or trade flow with their own dead band."""
    return leg_scores(pair_matrix(moves, cfg, end - cfg.session_window, end, dead), cfg.z)


def stamped_score(moves: DataFrame, regimes: DataFrame, cfg: Config, lo: int, end: int) -> DataFrame:
    """Scores of a trailing window with each leg's current regime; legs without one keep a null bucket."""
    scored = leg_scores(pair_matrix(moves, cfg, lo, end), cfg.z).withColumn("regime_bucket", F.lit(None).cast("string"))
    return lookup_join(scored, regimes.select(*LEG, "regime_bucket"), LEG)
