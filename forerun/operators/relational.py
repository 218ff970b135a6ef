"""Relational operators with the engine's semantics: lookups that overwrite, as-of values, upserts, ordered aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a matched row's columns overwrite those of the same name; unmatched rows keep theirs."""
    shared = [c for c in right.columns if c not in keys and c in left.columns]
    fresh = [c for c in right.columns if c not in keys and c not in left.columns]
    r = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("_r"))
    joined = left.join(r, keys, "left")
    cols = [F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns]
    return joined.select(*cols, *[F.col(f"_r.{c}").alias(c) for c in fresh])


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed merge, last write wins; ``order`` ranks changes of one key, all of them after the state."""
    cols = state.columns
    both = state.select(*cols, F.struct(F.lit(0).alias("side"), *[F.lit(None).cast(dict(changes.dtypes)[c]).alias(c) for c in order]).alias("_o")).unionByName(changes.select(*cols, F.struct(F.lit(1).alias("side"), *order).alias("_o")))
    rest = [c for c in cols if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_o").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def as_of(df: DataFrame, keys: list[str], time: str, seq: str, value: str, back: int, name: str) -> DataFrame:
    """The value at or before ``time - back`` within the key, else the key's first value."""
    by = Window.partitionBy(*keys).orderBy(time)
    upto = by.rangeBetween(Window.unboundedPreceding, -back)
    first = Window.partitionBy(*keys).orderBy(time, seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.max_by(value, F.struct(time, seq)).over(upto), F.first(value).over(first)))


def nearest_rank(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """sorted[floor(p * (n - 1))] for each p, and n; values are counted before the shuffle, so no group is collected."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    cum = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    picks = [F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col(value))).alias(name) for name, p in ranks.items()]
    return cum.groupBy(*keys).agg(*picks, F.first("_all").alias("n"))


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the median, between the middle two of an even number; values are counted before the shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    cum = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    low = F.min(F.when(2 * F.col("_upto") >= F.col("_all"), F.col(value)))
    high = F.min(F.when(2 * F.col("_upto") > F.col("_all"), F.col(value)))
    return cum.groupBy(*keys).agg(((low + high) / 2).alias(name))


def placed(df: DataFrame, time: str, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in the whole order: ranges of ``time`` are numbered side by side.

    The ranges' bounds are approximate quantiles, as many as there are shuffle partitions; a range's offset is the
    number of rows before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(time, [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    found = F.lit(0)
    for i, bound in enumerate(bounds):
        found = F.when(F.col(time) > bound, i + 1).otherwise(found)
    rows = df.withColumn("_range", found)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def absent_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key tuple is not in ``right``; nulls equal each other, and repeated rows stay."""
    cond = None
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = one if cond is None else cond & one
    return left.join(r, cond, "left_anti")
