"""Progress of a running search: callbacks for each batch of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from weft.operators.search import count_occurrences


class Progress(StreamingQueryListener):
    """Calls ``on_batch(batch, pages of it, pages so far)`` after each batch, and ``on_end`` once."""

    def __init__(self, on_batch: Callable[[int, int, int], None], on_end: Callable[[], None] = lambda: None):
        self.on_batch, self.on_end, self.pages = on_batch, on_end, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.pages += event.progress.numInputRows
        self.on_batch(event.progress.batchId, event.progress.numInputRows, self.pages)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.on_end()


def search_stream(spark: SparkSession, pages: DataFrame, query: str, sink: Callable[[DataFrame, int], None], progress: Progress, checkpoint: str):
    """Search of a stream of pages; results reach ``sink`` batch by batch, in no order: they carry their page's key."""
    spark.streams.addListener(progress)
    return count_occurrences(pages, query).writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
