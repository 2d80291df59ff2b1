"""All layers assembled from a configuration, and the job that builds the semantic index."""

from __future__ import annotations

from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from termloom.config import EngineConfig
from termloom.operators import notes, vectors
from termloom.operators.notes import Layer
from termloom.sources import tables
from termloom.sources.tables import KnowledgeBase


def plugin(name: str, what: str):
    """The function that "module:function" names."""
    module, _, function = name.partition(":")
    if not module or not function:
        raise ValueError(f"semantic.{what} must be module:function, not {name!r}")
    return getattr(import_module(module), function)


@dataclass
class Engine:
    """A knowledge base with the layers that its configuration asks for."""

    kb: KnowledgeBase
    cfg: EngineConfig
    semantic: list[Layer]

    def standardize(self, texts: DataFrame) -> DataFrame:
        """texts(note_id, text) to one row a note; see notes.standardize()."""
        return notes.standardize(texts, self.kb, self.cfg, self.semantic)


def build(spark: SparkSession, cfg: EngineConfig) -> Engine:
    """The engine of cfg: the knowledge base and, if semantic.enabled, the index, from the folders of cfg.paths."""
    semantic: list[Layer] = []
    if cfg.semantic.enabled:
        index, _ = tables.read_vectors(spark, cfg.paths.index)
        encode, recognise = plugin(cfg.semantic.encoder, "encoder"), plugin(cfg.semantic.recogniser, "recogniser")
        semantic.append(lambda n, done: vectors.layer(n, done, index, recognise, encode, cfg.semantic))
    return Engine(tables.read_kb(spark, cfg.paths.knowledge_base), cfg, semantic)


def build_index(spark: SparkSession, cfg: EngineConfig) -> None:
    """Encode the eligible aliases of the knowledge base and write the index to cfg.paths.index."""
    index = vectors.build_index(tables.read_kb(spark, cfg.paths.knowledge_base).aliases, plugin(cfg.semantic.encoder, "encoder"), cfg.fuzzy)
    tables.write_vectors(index, cfg.paths.index, cfg.semantic.encoder)
