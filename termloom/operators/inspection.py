"""Looking into a knowledge base: counts, top lists, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import normalize
from termloom.sources.tables import KnowledgeBase


def tally(df: DataFrame, what: str, by: Column | str) -> DataFrame:
    """(measure, value, n) of df's rows by one column."""
    return df.groupBy(F.coalesce((F.col(by) if isinstance(by, str) else by).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("measure"), "value", "n")


def concept_summary(kb: KnowledgeBase) -> DataFrame:
    return tally(kb.concepts, "entity_type", "entity_type").unionByName(kb.concepts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("concepts").alias("measure"), F.lit("all").alias("value"), "n"))


def alias_summary(kb: KnowledgeBase) -> DataFrame:
    out = tally(kb.aliases, "safe", "safe_for_exact_match")
    for c in ("alias_category", "target_type", "policy_reason"):
        out = out.unionByName(tally(kb.aliases, c, c))
    return out.unionByName(tally(kb.aliases, "ambiguous", F.col("ambiguous_targets").isNotNull()))


def ambiguous_aliases(kb: KnowledgeBase) -> DataFrame:
    return kb.aliases.where("ambiguous_targets IS NOT NULL").select("alias_raw", "alias_normalized", "target_id", F.array_join("ambiguous_targets", ",").alias("targets"))


def longest_technical(kb: KnowledgeBase, top: int = 20) -> DataFrame:
    return kb.aliases.where("alias_category = 'technical'").orderBy(F.length("alias_raw").desc(), "alias_raw", "target_id").limit(top).select("alias_raw", "target_id")


def brand_summary(kb: KnowledgeBase) -> DataFrame:
    return tally(kb.drug_brands, "brand_status", "brand_status")


def largest_brands(kb: KnowledgeBase, top: int = 20) -> DataFrame:
    return kb.drug_brands.select("brand_name", F.size("product_ids").cast("long").alias("n_products"), "brand_status", "brand_id").orderBy(F.desc("n_products"), "brand_id").limit(top).drop("brand_id")


def created_issues(kb: KnowledgeBase) -> DataFrame:
    return kb.issues.where(F.startswith("code", F.lit("created_missing_"))).groupBy("code", "item_id", "raw_name").agg(F.count(F.lit(1)).alias("n"))


def search(kb: KnowledgeBase, query: str, top: int | None = None) -> DataFrame:
    """(kind, id, name) of all records whose names hold the query, normalised or as it is; at most `top` of a kind if asked."""
    norm = normalize(F.lit(query))
    low = F.lower(F.lit(query))
    has = lambda c, part: F.contains(F.coalesce(c, F.lit("")), part)
    hits = [
        kb.aliases.where(has(F.col("alias_normalized"), norm) | has(F.lower("alias_raw"), low)).select(F.lit("alias").alias("kind"), F.col("target_id").alias("id"), F.col("alias_raw").alias("name")),
        kb.concepts.where(has(normalize(F.col("canonical_it")), norm) | has(normalize(F.col("canonical_en")), norm) | has(F.col("concept_id"), norm)).select(F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), F.col("canonical_it").alias("name")),
        kb.drug_products.where(has(normalize(F.col("drug_name")), norm) | has(normalize(F.col("brand_name")), norm)).select(F.lit("drug_product").alias("kind"), F.col("product_id").alias("id"), F.col("drug_name").alias("name")),
        kb.drug_brands.where(has(F.col("normalized_brand_name"), norm) | has(F.lower("brand_name"), low)).select(F.lit("drug_brand").alias("kind"), F.col("brand_id").alias("id"), F.col("brand_name").alias("name")),
    ]
    out = None
    for df in hits:
        df = df.orderBy("id", "name").limit(top) if top else df
        out = df if out is None else out.unionByName(df)
    return out
