"""Op-coded change streams feed an engine, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def maintain(engine: Engine, source: str, stream: DataFrame, checkpoint: str, flush: bool = True, **trigger) -> StreamingQuery:
    """Start applying a stream of rows with column __op to a source. A replayed batch is applied once."""

    def batch(log: DataFrame, batch_id: int) -> None:
        # a batch belongs to a session of its own: written down, the engine's session reads it
        engine.apply_log(source, engine.store.write("log", log), (source.lower(), checkpoint, batch_id))
        if flush:
            engine.flush()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
