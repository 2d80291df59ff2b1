"""From raw documents to token ids: STAGES in order, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, jaccard, mixing, secrets, toxicity
from termloom.llm.common import staged, table, unstage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores 0.5 or more go.

    Null and blank texts score the labels' share of toxic ones, so they stay where less than half are. Each row is judged by its own
    text, repeated rows and null doc_ids included; without labels of both kinds nothing goes but at a prior of 0.5.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest doc_id stays.

    Null and blank texts are linked with nothing and stay. Rows equal in doc_id and text count once; rows that share a doc_id go only
    with a survivor of their own group; rows without a doc_id stay.
    """
    return jaccard.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; n_chars follows the text (null where it is null).

    Every row stays, repeated ones and null doc_ids included; null and empty texts have no secret.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: 0, 1 or 2 times.

    Null and blank texts have size 0 and spend nothing of a target. A null source is a source by itself. Rows that repeat a doc_id, or have
    none, are drawn each by itself.
    """
    mixed = mixing.mix(docs).where("mix_copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to.

    Null and empty texts have no ids. Rows stay one to one, whether doc_ids repeat or are null.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", one_of_each_group),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, then deleted once the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        unstage(*before)
        before = [docs]
    return docs
