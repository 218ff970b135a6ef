"""Watching running streams: feeds that fall silent, and ordered start and stop."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger("forerun")

#: Seconds without a row after which a feed counts as idle.
IDLE_SECONDS = 90.0


class IdleListener(StreamingQueryListener):
    """Calls ``on_idle(name, seconds)`` once when a stream has had no rows for a while; rows arm it again."""

    def __init__(self, on_idle: Callable[[str, float], None], seconds: float = IDLE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.on_idle, self.seconds, self.clock = on_idle, seconds, clock
        self.last: dict[str, float] = {}
        self.told: set[str] = set()

    def seen(self, name: str, rows: int) -> None:
        now = self.clock()
        if rows or name not in self.last:
            self.last[name] = now
            self.told.discard(name)
        elif now - self.last[name] > self.seconds and name not in self.told:
            self.told.add(name)
            self.on_idle(name, now - self.last[name])

    def onQueryStarted(self, event) -> None:
        self.seen(event.name or str(event.id), 1)

    def onQueryProgress(self, event) -> None:
        self.seen(event.progress.name or str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.seen(str(event.id), 0)

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended", event.id)


def start_all(streams: dict[str, tuple[DataFrame, Callable[[DataFrame, int], None]]], checkpoints: str, every: str = "1 second") -> list[StreamingQuery]:
    """Start each stream's foreachBatch in order; if one fails to start, those before are stopped again."""
    running: list[StreamingQuery] = []
    try:
        for name, (frame, batch) in streams.items():
            running.append(frame.writeStream.queryName(name).foreachBatch(batch).option("checkpointLocation", f"{checkpoints}/{name}").trigger(processingTime=every).start())
    except Exception:
        stop_all(running)
        raise
    return running


def stop_all(running: list[StreamingQuery]) -> None:
    """Stop in reverse order, so that consumers end before what they read."""
    for q in reversed(running):
        if q.isActive:
            q.stop()
