"""Feeds: rows of declared tables, routing of mixed messages, and connecting with patience."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger("forerun")


def to_table(spark: SparkSession, rows: DataFrame | Iterable[tuple], schema: str) -> DataFrame:
    """Rows with the declared names and types: of a table by name, of tuples by position."""
    if isinstance(rows, DataFrame):
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    return spark.createDataFrame(list(rows), schema)


def dispatcher(handlers: dict[str, Callable[[DataFrame, int], None]], table: str = "table") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each table's rows to its handler and ignores tables without one.

    Handlers run in the order given; a batch is read again for each, so it is kept while they run.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        kept = batch.where(F.col(table).isin(list(handlers))).persist()
        try:
            there = {r[0] for r in kept.select(table).distinct().collect()}  # names of tables
            for name, handler in handlers.items():
                if name in there:
                    handler(kept.where(F.col(table) == name).drop(table), epoch)
        finally:
            kept.unpersist()

    return run


def connect(make: Callable[[], object], tries: int = 30, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """What ``make`` gives, tried again after each failure; the last failure is raised."""
    for i in range(1, tries + 1):
        try:
            return make()
        except Exception as failure:
            if i == tries:
                raise
            log.warning("connecting failed (%d of %d): %s", i, tries, failure)
            sleep(wait)
    raise ValueError("tries must be positive")
