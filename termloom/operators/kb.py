"""Building the knowledge base: concepts, aliases, products, brands, issues and a report from two raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.config import EngineConfig
from termloom.functions import policy
from termloom.functions.text import base_name, normalize, normalize_for_id
from termloom.sources.tables import KnowledgeBase

# Priorities of aliases by where they come from.
PRIORITY = {"it": 95, "en": 90, "synonym_it": 80, "synonym_en": 75, "created": 90, "product": 90, "brand": 85}


def order(stage: int, seq: Column, role: Column | int = 0, pos: Column | int = 0) -> Column:
    """The place of a row among all that are merged: synonym rows, then what products add, then products; within, rows, roles, positions."""
    cell = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.struct(F.lit(stage).alias("stage"), cell(seq).alias("seq"), cell(role).alias("role"), cell(pos).alias("pos"))


def concept_id(entity_type: Column, name: Column) -> Column:
    return F.concat(F.replace(entity_type, F.lit("/"), F.lit("_")), F.lit(":"), normalize_for_id(name))


def synonym_concepts(synonyms: DataFrame) -> DataFrame:
    return synonyms.select(
        order(0, F.col("seq")).alias("seq"), concept_id(F.col("entity_type"), F.col("ingredient_it")).alias("concept_id"), "entity_type",
        F.col("ingredient_it").alias("canonical_it"), F.col("ingredient_en").alias("canonical_en"), F.array(F.lit("UMLS")).alias("sources"),
    )


def merge_concepts(rows: DataFrame) -> DataFrame:
    """One row a concept: the first row's type and name, the first English name there is, all sources in order."""
    first = lambda c: F.min_by(c, "seq").alias(c)
    return rows.groupBy("concept_id").agg(
        first("entity_type"), first("canonical_it"), F.min_by("canonical_en", F.when(F.col("canonical_en").isNotNull(), F.col("seq"))).alias("canonical_en"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )


def make_aliases(rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """rows(seq, alias_raw, target_id, target_type, language, source, priority) normalised and classified; blank aliases go."""
    named = rows.withColumn("alias_raw", F.trim("alias_raw")).withColumn("alias_normalized", normalize(F.col("alias_raw"), cfg.normalizer))
    named = named.where("alias_normalized <> ''").withColumn("p", policy.classify(F.col("alias_raw"), F.col("alias_normalized"), cfg.policy))
    return named.select(
        "seq", "alias_raw", "alias_normalized", "target_id", "target_type", "language", "source", F.col("p.category").alias("alias_category"), F.col("priority").cast("int").alias("priority"),
        F.col("p.safe").alias("safe_for_exact_match"), F.col("p.requires_context").alias("requires_context"), F.col("p.reason").alias("policy_reason"),
    )


def synonym_aliases(synonyms: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Each row's own names, then its synonyms, in both languages."""
    def entry(name: Column, language: str, priority: int) -> Column:
        return F.struct(name.alias("alias_raw"), F.lit(language).alias("language"), F.lit(priority).alias("priority"))

    names = F.concat(
        F.array(entry(F.col("ingredient_it"), "it", PRIORITY["it"])), F.array(entry(F.col("ingredient_en"), "en", PRIORITY["en"])),
        F.transform("synonyms_it", lambda x: entry(x, "it", PRIORITY["synonym_it"])), F.transform("synonyms_en", lambda x: entry(x, "en", PRIORITY["synonym_en"])),
    )
    each = synonyms.select("seq", concept_id(F.col("entity_type"), F.col("ingredient_it")).alias("target_id"), F.posexplode(names).alias("k", "n")).where("n.alias_raw IS NOT NULL")
    return make_aliases(each.select(order(0, F.col("seq"), 0, F.col("k")).alias("seq"), "n.alias_raw", "target_id", F.lit("ingredient").alias("target_type"), "n.language", F.lit("UMLS").alias("source"), "n.priority"), cfg)


def ingredient_index(aliases: DataFrame) -> DataFrame:
    """(alias_normalized, concept_id) where the alias names one concept only."""
    return aliases.groupBy("alias_normalized").agg(F.min("target_id").alias("concept_id"), F.max("target_id").alias("other")).where("concept_id = other").drop("other")


def resolve_ingredients(drugs: DataFrame, index: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row an ingredient of a drug: seq, drug_code, role, pos, name, concept_id, created (the index doesn't know it)."""
    def part(column: str, role: str) -> Column:
        return F.transform(column, lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), x.alias("name")))

    each = drugs.select("seq", "drug_code", F.explode(F.concat(part("compositions", "active"), part("excipients", "inactive"))).alias("i")).select("seq", "drug_code", "i.*")
    each = each.withColumn("alias_normalized", normalize(F.col("name"), cfg.normalizer)).join(index, "alias_normalized", "left")
    return each.select("seq", "drug_code", "role", "pos", "name", F.coalesce("concept_id", concept_id(F.col("role"), F.col("name"))).alias("concept_id"), F.col("concept_id").isNull().alias("created"))


def issues(resolved: DataFrame) -> DataFrame:
    """One row for each occurrence of an ingredient that had to be made."""
    return resolved.where("created").select(
        F.lit("info").alias("severity"), F.concat(F.lit("created_missing_"), F.col("role"), F.lit("_concept")).alias("code"),
        F.concat(F.lit("Created a concept for "), F.col("name")).alias("message"), F.col("concept_id").alias("item_id"), F.col("name").alias("raw_name"), "drug_code",
    )


def _order(resolved: DataFrame) -> Column:
    return order(1, F.col("seq"), F.when(F.col("role") == "active", 0).otherwise(1), F.col("pos"))


def created(resolved: DataFrame) -> DataFrame:
    """(role, name, concept_id, seq) of each distinct ingredient that had to be made, at its first place."""
    return resolved.where("created").groupBy("role", "name", "concept_id").agg(F.min(_order(resolved)).alias("seq"))


def created_concepts(made: DataFrame) -> DataFrame:
    return made.select("seq", "concept_id", F.col("role").alias("entity_type"), F.col("name").alias("canonical_it"), F.lit(None).cast("string").alias("canonical_en"), F.array(F.lit("AIFA")).alias("sources"))


def created_aliases(made: DataFrame, cfg: EngineConfig) -> DataFrame:
    return make_aliases(made.select(
        "seq", F.col("name").alias("alias_raw"), F.col("concept_id").alias("target_id"), F.lit("ingredient").alias("target_type"),
        F.lit("it").alias("language"), F.lit("AIFA").alias("source"), F.lit(PRIORITY["created"]).alias("priority"),
    ), cfg)


def build_products(drugs: DataFrame, resolved: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row a drug row, with sorted distinct ingredient ids; seq kept for the steps that follow."""
    ids = lambda role: F.array_sort(F.array_compact(F.collect_set(F.when(F.col("role") == role, F.col("concept_id")))))
    found = resolved.groupBy("seq").agg(ids("active").alias("active_ingredient_ids"), ids("inactive").alias("excipient_ids"))
    none = F.array().cast("array<string>")
    full = F.trim("drug_name")
    base = base_name(full)
    return drugs.join(found, "seq", "left").select(
        "seq", F.concat(F.lit("drug:aic:"), F.col("drug_code")).alias("product_id"), "drug_code", "drug_name", F.nullif(base, F.lit("")).alias("brand_name"),
        F.nullif(normalize(base, cfg.normalizer), F.lit("")).alias("normalized_brand_name"), "drug_form", "atc",
        F.coalesce("active_ingredient_ids", none).alias("active_ingredient_ids"), F.coalesce("excipient_ids", none).alias("excipient_ids"), F.lit("AIFA").alias("source"),
        normalize(full, cfg.normalizer).alias("normalized_full_name"),
    )


def brand_id(name: Column) -> Column:
    return F.concat(F.lit("brand:"), normalize_for_id(name))


def drug_aliases(products: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The full name of each product, and its base name as an alias of the brand."""
    shared = [F.lit("it").alias("language"), F.lit("AIFA").alias("source")]
    full = products.select(order(2, F.col("seq")).alias("seq"), F.col("drug_name").alias("alias_raw"), F.col("product_id").alias("target_id"), F.lit("drug_product").alias("target_type"), *shared, F.lit(PRIORITY["product"]).alias("priority"))
    # a base name that many products share is one alias, at its first place
    named = products.where("brand_name IS NOT NULL").groupBy("brand_name").agg(F.min("seq").alias("seq"))
    base = named.select(order(2, F.col("seq"), 1).alias("seq"), F.col("brand_name").alias("alias_raw"), brand_id(F.col("brand_name")).alias("target_id"), F.lit("drug_brand").alias("target_type"), *shared, F.lit(PRIORITY["brand"]).alias("priority"))
    return make_aliases(full.unionByName(base), cfg)


def build_brands(products: DataFrame) -> DataFrame:
    """Products grouped by the id of their base name, with the distinct sets of actives and what they say of the brand."""
    named = products.where("brand_name IS NOT NULL").withColumn("brand_id", brand_id(F.col("brand_name")))
    g = named.groupBy("brand_id").agg(
        F.min_by("brand_name", "seq").alias("brand_name"), F.min_by("normalized_brand_name", "seq").alias("normalized_brand_name"), F.array_sort(F.collect_list("product_id")).alias("product_ids"),
        F.array_sort(F.array_compact(F.collect_set(F.when(F.size("active_ingredient_ids") > 0, F.col("active_ingredient_ids"))))).alias("active_ingredient_signatures"),
    )
    sigs = F.col("active_ingredient_signatures")
    status = F.when(F.size(sigs) != 1, "ambiguous_brand").when(F.size(F.get(sigs, F.lit(0))) == 1, "single_active_signature").otherwise("multi_active_signature")
    return g.select("brand_id", "brand_name", "normalized_brand_name", "product_ids", F.array_sort(F.array_distinct(F.flatten(sigs))).alias("active_ingredient_ids"), "active_ingredient_signatures", status.alias("brand_status"))


def dedup_aliases(aliases: DataFrame) -> DataFrame:
    """One row for each (alias_normalized, target_id, target_type): highest priority, then earliest."""
    keys = ["alias_normalized", "target_id", "target_type"]
    kept = [c for c in aliases.columns if c not in keys]
    best = F.min_by(F.struct(*kept), F.struct(-F.col("priority"), F.col("seq"))).alias("best")
    g = aliases.groupBy(*keys).agg(best, F.min_by(F.col("priority"), "seq").alias("first_priority"))
    replaced = F.when(F.col("best.priority") > F.col("first_priority"), F.lit("higher_priority_duplicate"))
    return g.select(*keys, *(F.col(f"best.{c}").alias(c) for c in kept), replaced.alias("deduplicated_from"))


def shared_names(aliases: DataFrame) -> DataFrame:
    """(alias_normalized, target_type, ambiguous_targets) of the aliases that name several targets of one type."""
    return aliases.groupBy("alias_normalized", "target_type").agg(F.array_sort(F.collect_set("target_id")).alias("ambiguous_targets")).where(F.size("ambiguous_targets") > 1)


def mark_ambiguous(aliases: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Aliases that name several targets of one type become unsafe and list them. Targets of other types don't count.

    Each of n such aliases lists n targets, so the lists grow with the square of n: what is stored should be the aliases and shared_names()
    apart, joined again by with_targets().
    """
    j = with_targets(aliases, shared_names(aliases) if shared is None else shared)
    hit = F.col("ambiguous_targets").isNotNull()
    return j.withColumn("safe_for_exact_match", F.col("safe_for_exact_match") & ~hit).withColumn("requires_context", F.col("requires_context") | hit)


def with_targets(aliases: DataFrame, shared: DataFrame) -> DataFrame:
    return aliases.join(shared, ["alias_normalized", "target_type"], "left")


def build_report(concepts: DataFrame, aliases: DataFrame, products: DataFrame, brands: DataFrame, found: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    of_aliases = aliases.agg(n.alias("aliases_count"), F.count_if(F.col("ambiguous_targets").isNotNull()).alias("ambiguous_aliases_count"), F.count_if(F.col("policy_reason") == "short_alias").alias("unsafe_short_aliases_count"))
    of_brands = brands.agg(n.alias("drug_brands_count"), F.count_if(F.col("brand_status") == "ambiguous_brand").alias("ambiguous_brands_count"))
    one_row = [concepts.agg(n.alias("concepts_count")), of_aliases, products.agg(n.alias("drug_products_count")), of_brands, found.agg(n.alias("unresolved_product_ingredients_count"))]
    out = one_row[0]
    for df in one_row[1:]:
        out = out.crossJoin(df)
    return out.select("concepts_count", "aliases_count", "drug_products_count", "drug_brands_count", "ambiguous_aliases_count", "unsafe_short_aliases_count", "unresolved_product_ingredients_count", "ambiguous_brands_count")


COLUMNS = "alias_raw alias_normalized target_id target_type language source alias_category priority safe_for_exact_match requires_context policy_reason ambiguous_targets deduplicated_from".split()


def build(synonyms: DataFrame, drugs: DataFrame, cfg: EngineConfig = EngineConfig(), stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> KnowledgeBase:
    """The whole knowledge base from cleaned synonym and drug rows. What several tables are made of goes through stage(df, name) once."""
    from_synonyms = synonym_aliases(synonyms, cfg)
    resolved = stage(resolve_ingredients(drugs, ingredient_index(from_synonyms), cfg), "resolved")
    made = stage(created(resolved), "created")
    concepts = merge_concepts(synonym_concepts(synonyms).unionByName(created_concepts(made)))
    products = stage(build_products(drugs, resolved, cfg), "products")
    brands = stage(build_brands(products), "brands")
    every = from_synonyms.unionByName(created_aliases(made, cfg)).unionByName(drug_aliases(products, cfg))
    each = stage(dedup_aliases(every).drop("seq"), "aliases")
    shared = stage(shared_names(each), "shared")
    aliases = mark_ambiguous(each, shared).select(*COLUMNS)
    found = issues(resolved)
    products = products.drop("seq")
    return KnowledgeBase(concepts, aliases, products, brands, found, build_report(concepts, aliases, products, brands, found))


def validate(kb: KnowledgeBase) -> DataFrame:
    """(rule, violations) of the tables' constraints: ids, prefixes, ranges."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    prefix = F.concat(F.replace("entity_type", F.lit("/"), F.lit("_")), F.lit(":"))
    rules = [
        (kb.concepts, "concept_blank", blank("concept_id") | blank("canonical_it")), (kb.concepts, "concept_prefix", ~F.startswith("concept_id", prefix)),
        (kb.aliases, "alias_blank", blank("alias_raw") | blank("alias_normalized") | blank("target_id")), (kb.aliases, "alias_priority", ~F.col("priority").between(0, 100)),
        (kb.drug_products, "product_blank", blank("drug_code") | blank("drug_name")), (kb.drug_products, "product_prefix", ~F.startswith("product_id", F.lit("drug:aic:"))),
        (kb.drug_brands, "brand_blank", blank("brand_id") | blank("brand_name")), (kb.drug_brands, "brand_prefix", ~F.startswith("brand_id", F.lit("brand:"))),
    ]
    out = None
    for df, name, bad in rules:
        row = df.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
