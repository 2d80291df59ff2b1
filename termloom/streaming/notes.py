"""Standardising a stream of notes: each micro-batch is a batch of notes against the same knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termloom.config import EngineConfig
from termloom.operators.notes import Layer, standardize
from termloom.sources.tables import KnowledgeBase


def standardize_stream(notes: DataFrame, kb: KnowledgeBase, folder: str, checkpoint: str, cfg: EngineConfig = EngineConfig(), semantic: Layer | None = None, available_now: bool = False) -> StreamingQuery:
    """Write the standardised notes of a stream(note_id, text) as Parquet, one subfolder for each batch.

    A batch that is run again overwrites its own subfolder, so each note comes out once.
    """
    def one(batch: DataFrame, number: int) -> None:
        standardize(batch, kb, cfg, semantic).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = notes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
