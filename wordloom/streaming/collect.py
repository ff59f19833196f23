"""Collect events as a stream, folded into the user words of a store (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.mutate import collect_words
from wordloom.sources.store import Store


def collect_stream(events: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch becomes one snapshot."""

    def fold(batch: DataFrame, _: int) -> None:
        store.write({"user_words": collect_words(store.read("user_words"), batch, F.current_timestamp(), store.next_id("user_words"))})

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
