"""Progress of streams, as a callback gets it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls back with {query, batch, rows, rows_per_second} for each batch, and {query, done, error} at a stream's end."""

    def __init__(self, call: Callable[[dict], None]):
        self.call = call

    def onQueryStarted(self, event):  # noqa: N802
        self.call({"query": str(event.id), "started": True})

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.call({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.call({"query": str(event.id), "done": True, "error": event.exception})


def watch(spark: SparkSession, call: Callable[[dict], None]) -> Callable[[], None]:
    """Begin to call back; the function returned ends it."""
    listener = Progress(call)
    spark.streams.addListener(listener)
    return lambda: spark.streams.removeListener(listener)
