"""Progress of streams, from the figures that the plan itself observes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(stream: DataFrame, name: str, **figures: Column) -> DataFrame:
    """``stream`` with figures observed as its rows pass: ``rows``, and aggregates of one's own."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in figures.items()))


class Progress(StreamingQueryListener):
    """Calls ``tell(name, done)`` after each batch, ``done`` being the totals so far of what ``observed`` watches; batches that fail or repeat count once.

    A total is a sum over batches, so figures should be counts or sums.
    """

    def __init__(self, name: str, tell: Callable[[str, dict], None]):
        self.name, self.tell = name, tell
        self.batches: dict[tuple[str, int], dict] = {}
        self.error: str | None = None
        self.ended = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get(self.name)
        if found is None:
            return
        self.batches[str(p.id), p.batchId] = {k: v or 0 for k, v in found.asDict().items()}
        totals: dict = {}
        for one in self.batches.values():
            for k, v in one.items():
                totals[k] = totals.get(k, 0) + v
        self.tell(self.name, totals)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.error, self.ended = event.exception, True


def watch(spark: SparkSession, name: str, tell: Callable[[str, dict], None]) -> Progress:
    """Registers a ``Progress``; ``spark.streams.removeListener`` takes it off again."""
    found = Progress(name, tell)
    spark.streams.addListener(found)
    return found
