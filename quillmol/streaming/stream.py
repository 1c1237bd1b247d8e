"""Extension: molecules that arrive as a stream, scored against fixed templates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmol.plans import engine


def score_stream(molecules: DataFrame, templates: DataFrame, method: str, sink, checkpoint: str, **kw):
    """Scores each micro-batch (name, s) as a batch query and hands it to sink(frame, batch_id). TF-IDF methods take a frozen
    model, so that a batch's weights don't depend on when it arrives. Returns the started query."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(engine.cross_similarity(batch, templates, method, **kw), batch_id)

    return molecules.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
