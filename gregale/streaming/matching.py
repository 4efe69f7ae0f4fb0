"""Matching a stream of new rows against the static historical store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gregale.operators.similarity import cosine_candidates


def match_stream(new: DataFrame, old: DataFrame, block: list[str], id_col: str, text_col: str, least: float, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of new rows meets the store; sink gets (block..., a, b, cos) and the batch's number, which makes it idempotent."""
    return new.writeStream.foreachBatch(lambda batch, n: sink(cosine_candidates(old, batch, block, id_col, text_col, least), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
