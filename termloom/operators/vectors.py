"""The semantic layer: exact nearest neighbours by cosine, in blocks, and what feeds and follows it.

Encoder and entity recogniser are functions from DataFrame to DataFrame, so any model can stand behind them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.config import FuzzyConfig, SemanticConfig
from termloom.functions.scan import each_note
from termloom.functions.text import compact_length
from termloom.operators.fuzzy import accept, eligible
from termloom.operators.overlap import without_overlap

BLANK = " \t\n\x0b\f\r"
EDGE = ".,;:!?()[]{}"
BLOCK = 2048
#: texts(text) to (text, vector array<float>).
Encoder = Callable[[DataFrame], DataFrame]
#: notes(note_id, norm) to (note_id, entity_group, entity, word, start, end, score).
Recogniser = Callable[[DataFrame], DataFrame]


def normalized(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))


def select_for_index(aliases: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Eligible aliases, one for each (alias_normalized, target_id): the first by raw spelling."""
    cols = ["alias_raw", "target_type", "alias_category", "priority", "policy_reason", "requires_context"]
    g = eligible(aliases, cfg).groupBy("alias_normalized", "target_id").agg(F.min_by(F.struct(*cols), F.struct(-F.col("priority"), F.col("alias_raw"))).alias("a"))
    return g.select("alias_normalized", "target_id", "a.*")


def build_index(aliases: DataFrame, encode: Encoder, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Aliases for the index with their unit vectors and a stable id."""
    chosen = select_for_index(aliases, cfg)
    vectors = encode(chosen.select(F.col("alias_normalized").alias("text")).distinct()).withColumnRenamed("text", "alias_normalized")
    return chosen.join(vectors, "alias_normalized").withColumn("vector", normalized(F.col("vector"))).withColumn("vector_id", F.xxhash64("alias_normalized", "target_id"))


def nearest(queries: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vector_id, similarity, rn): the k nearest of index(vector_id, vector) for every row of queries(query_id, vector).

    Both sides are cut into blocks of about BLOCK rows by a hash; each pair of blocks is one matrix product, of
    which k neighbours a query are kept, and the best of those are ranked. Rows of a block are in order of vector_id, so that
    both cuts break ties by it. Similarity is clamped to [-1, 1]. Every query meets every row: a stated set of queries, not all pairs, is what
    this is for.
    """
    q_id, v_id = queries.schema["query_id"].dataType.simpleString(), index.schema["vector_id"].dataType.simpleString()
    n_index, n_queries = (max(1, -(-df.count() // BLOCK)) for df in (index, queries))
    cells = index.select("vector_id", "vector").groupBy(F.pmod(F.xxhash64("vector_id"), F.lit(n_index)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("vector_id", "vector"))).alias("rows"))
    asked = queries.select("query_id", "vector").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).alias("qblock")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    # each block of queries goes to every block of the index: a product of both sizes, which must not be taken for a small side and broadcast
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1)))).hint("merge").join(cells.withColumn("block", F.col("block").cast("int")), "block")

    def unit(rows) -> np.ndarray:
        m = np.array([r["vector"] for r in rows], np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked_rows, rows in zip(batch["asked"], batch["rows"]):
                sims = np.clip(unit(asked_rows) @ unit(rows).T, -1.0, 1.0)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                ids = np.array([r["vector_id"] for r in rows], dtype=object)
                yield pd.DataFrame({"query_id": np.repeat([r["query_id"] for r in asked_rows], top.shape[1]), "vector_id": ids[top.ravel()], "similarity": np.take_along_axis(sims, top, 1).ravel().astype(float)})

    # two blocks of vectors at most are multiplied at once; how many pairs a batch brings is bounded by Spark's bytes of an Arrow batch
    best = pairs.select("asked", "rows").mapInPandas(run, f"query_id {q_id}, vector_id {v_id}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


REASONS = ("below_semantic_similarity_threshold", "ambiguous_semantic_match")


def decide(neighbours: DataFrame, cfg: SemanticConfig = SemanticConfig(), key: str = "text") -> DataFrame:
    """neighbours(key, score, priority, target_id, alias_normalized, ...) to one decision for each key."""
    return accept(neighbours, F.lit(cfg.threshold), cfg.margin, cfg.neighbours, REASONS, key, ())


def entity_label(group: Column, entity: Column) -> Column:
    return F.upper(F.replace(F.replace(F.coalesce(F.nullif(group, F.lit("")), entity, F.lit("")), F.lit("B-"), F.lit("")), F.lit("I-"), F.lit("")))


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end, text): the span without blanks, then punctuation, at its edges; offsets follow."""
    n = F.length(text)
    a, b = (F.greatest(F.lit(0), F.least(x, n)) for x in (start, end))
    piece = F.when(a < b, F.substring(text, a + 1, b - a)).otherwise("")

    def cut(s: Column, at: Column, chars: str) -> tuple[Column, Column]:
        left = F.ltrim(s, F.lit(chars))
        return F.rtrim(left, F.lit(chars)), at + F.length(s) - F.length(left)

    one, at = cut(piece, a, BLANK)
    two, at = cut(one, at, EDGE)
    return F.struct(at.alias("start"), (at + F.length(two)).alias("end"), two.alias("text"))


def entity_candidates(notes: DataFrame, entities: DataFrame, protected: DataFrame, cfg: SemanticConfig = SemanticConfig()) -> DataFrame:
    """(note_id, start, end, text) of the entities of an asked label, trimmed, long enough, that overlap nothing protected.

    The spans of a note's entities are cut out in one pass over it.
    """
    asked = entities.where(entity_label(F.col("entity_group"), F.col("entity")).isin(*cfg.labels))
    found = notes.select("note_id", "norm").join(asked.groupBy("note_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "note_id")

    def make():
        def emit(norm, spans, starts, ends, texts):
            size = len(norm)
            for span in spans:
                a, b = (max(0, min(size if x is None else x, size)) for x in (span["start"], span["end"]))
                text = norm[a:b] if a < b else ""
                for chars in (BLANK, EDGE):
                    left = text.lstrip(chars)
                    a, text = a + len(text) - len(left), left.rstrip(chars)
                if text:
                    starts.append(a)
                    ends.append(a + len(text))
                    texts.append(text)

        return emit

    e = each_note(found.where("norm IS NOT NULL"), ["norm", "spans"], {"start": "int", "end": "int", "text": "string"}, make)
    kept = e.where((F.col("text") != "") & (compact_length(F.col("text")) >= cfg.min_candidate_chars))
    return without_overlap(kept, protected).distinct()


def layer(notes: DataFrame, protected: DataFrame, index: DataFrame, recognise: Recogniser, encode: Encoder, cfg: SemanticConfig = SemanticConfig()) -> DataFrame:
    """Accepted semantic matches as candidates. Each distinct text is encoded and searched once."""
    spans = entity_candidates(notes, recognise(notes), protected, cfg)
    texts = encode(spans.select("text").distinct())
    found = nearest(texts.select(F.col("text").alias("query_id"), "vector"), index, cfg.neighbours).withColumnRenamed("query_id", "text").join(index.drop("vector"), "vector_id")
    best = decide(found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))), cfg).where("accepted")
    return spans.join(best.select("text", "score", "target_id", "target_type", "alias_raw", "alias_normalized", "requires_context"), "text").select(
        "note_id", F.col("text").alias("surface"), "start", "end", "target_id", "target_type", "alias_raw", "alias_normalized", F.lit("clinical").alias("alias_category"),
        F.col("score").alias("confidence"), F.lit(cfg.priority).alias("priority"), F.lit("semantic_embedding").alias("method"), "requires_context",
    )
