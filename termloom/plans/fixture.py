"""A knowledge base derived from the driver's tables: no raw one is at hand.

Synonym rows are made of the words of `documents` that at least 2 % of the documents have; drug rows of `part`. SQL
builds the same tables in DuckDB, as a chain of common table expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.config import EngineConfig
from termloom.functions import policy
from termloom.functions.text import fold_text
from termloom.operators import kb
from termloom.sources.raw import clean_drugs, clean_synonyms
from termloom.sources.staging import staged
from termloom.sources.tables import KnowledgeBase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key if it lies in fewer files than there are cores; large tables come in many files and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text"), "note_id")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def document_counts(docs: DataFrame) -> DataFrame:
    """(tok, df): words of five letters or more, with the documents of some of docs' rows that have them; several rows a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile("[a-z]{5,}")
        for batch in batches:
            df: Counter[str] = Counter()
            for text in batch.column(0):
                if text.is_valid:
                    df.update(set(words.findall(fold_text(text.as_py()))))
            yield pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64())], ["tok", "df"])

    return docs.select("text").mapInArrow(run, "tok string, df long")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tok, r): words of five letters or more in at least 2 % of the documents, by falling document frequency."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    common = document_counts(docs).groupBy("tok").agg(F.sum("df").alias("df")).crossJoin(docs.agg(F.count(F.lit(1)).alias("n"))).where("50 * df >= n")
    # a document has only so many words, so at most fifty times that many are this common
    return common.select("tok", F.row_number().over(Window.orderBy(F.desc("df"), "tok")).alias("r"))


def raw_synonyms(vocab: DataFrame) -> DataFrame:
    w = Window.orderBy("r")
    t = vocab.select("r", "tok", *(F.lead("tok", k).over(w).alias(f"t{k}") for k in range(1, 5))).where("r % 4 = 1").withColumn("seq", ((F.col("r") - 1) / 4).cast("long"))
    kind = F.element_at(F.array(*map(F.lit, ("active", "inactive", "active/inactive"))), (F.col("seq") % 3).cast("int") + 1)
    return t.select(
        "seq", F.col("tok").alias("ingredient_it"), F.when(F.col("seq") % 2 == 0, F.upper("t1")).alias("ingredient_en"), kind.alias("type"),
        F.array("t2", F.concat_ws(" ", "tok", "t2")).alias("synonyms_it"), F.array("t3", "t4").alias("synonyms_en"),
    )


def raw_drugs(part: DataFrame, vocab: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    size = vocab.agg(F.count(F.lit(1)).alias("n"))
    p = part.crossJoin(size).withColumn("r", (k % F.greatest(F.col("n"), F.lit(1)) + 1).cast("int")).join(vocab, "r", "left").withColumn("tok", F.coalesce("tok", F.lit("nothing")))
    base = F.when(k % 7 == 3, F.upper("tok")).when(k % 5 == 0, F.upper("p_brand")).otherwise(F.upper("p_name"))
    words = F.replace("p_name", F.lit(" "), F.lit("#"))
    composition = F.when(k % 7 == 3, F.col("tok")).when(k % 5 == 0, F.concat_ws("#", words, "tok")).otherwise(words)
    return p.select(k.alias("seq"), k.cast("string").alias("aic"), F.concat(base, F.lit("*"), F.col("p_size").cast("string"), F.lit("CPR")).alias("drug_name"), F.col("p_type").alias("atc"), composition.alias("composition"), F.col("p_type").alias("excipients"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_synonyms(raw_synonyms(vocabulary(spark, sf_dir)))


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_drugs(raw_drugs(part(spark, sf_dir), vocabulary(spark, sf_dir)))


def build(spark: SparkSession, sf_dir: str, cfg: EngineConfig = EngineConfig()) -> KnowledgeBase:
    """The knowledge base, built anew; the two raw tables, and what its tables share, are staged first."""
    vocab = staged(vocabulary(spark, sf_dir), "vocabulary")
    syn = staged(clean_synonyms(raw_synonyms(vocab)), "synonyms")
    drug = staged(clean_drugs(raw_drugs(part(spark, sf_dir), vocab)), "drugs")
    return kb.build(syn, drug, cfg, staged)


_built: dict[tuple[str, str], KnowledgeBase] = {}


def knowledge_base(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """build() once for a session and folder. Its tables read what is staged; targets of ambiguous aliases are listed when they are asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        made = build(spark, sf_dir)
        _built[key] = replace(made, concepts=staged(made.concepts, "concepts"), report=staged(made.report, "report"))
    return _built[key]


def misspelt(vocab: DataFrame) -> DataFrame:
    """(text): each word of the vocabulary with its third letter left out, with two letters swapped, and two words swapped around."""
    w = Window.orderBy("r")
    v = vocab.withColumn("next", F.lead("tok", 2).over(w))
    cut = F.concat(F.substring("tok", 1, 2), F.substring(F.col("tok"), F.lit(4), F.length("tok")))
    swap = F.concat(F.substring("tok", 1, 2), F.substring("tok", 4, 1), F.substring("tok", 3, 1), F.substring(F.col("tok"), F.lit(5), F.length("tok")))
    return v.select(F.explode(F.array(cut, swap, F.concat_ws(" ", "next", "tok"))).alias("text")).where(F.length("text") >= 6).distinct()


FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"


def sql_norm(t: str) -> str:
    kept = f"regexp_replace({FOLD.format(f'coalesce({t}, {chr(39) * 2})')}, '[^\\w\\s+\\-''.]', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({kept}, '\\b(e)\\s+(\\d{{3,4}})\\b', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"


def sql_id(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({sql_norm(t)}, ' ', '_'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"


def matches_sql(text: str, pattern: str) -> str:
    """Whether a pattern of policy.py is found in text; DuckDB's patterns know no flag u."""
    return f"regexp_matches({text}, '{pattern.replace('(?iu)', '(?i)')}')"


def sql_policy(raw: str, norm: str) -> str:
    """The index of the rule that decides, 0 to 5."""
    code, stereo, complex_, formula = (matches_sql(raw, p) for p in (policy.CLINICAL_CODE, policy.STEREO, policy.COMPLEX, policy.FORMULA))
    marks = f"len(regexp_extract_all({raw}, '{policy.PUNCTUATION}'))"
    acronym = matches_sql(f"regexp_replace({raw}, '[^A-Za-z]', '', 'g')", policy.ACRONYM)
    return (
        f"CASE WHEN {norm} = '' THEN 0 WHEN {acronym} THEN 1 "
        f"WHEN {code} OR {matches_sql(norm, policy.CLINICAL_CODE)} THEN 2 WHEN length(replace({norm}, ' ', '')) < 5 THEN 3 "
        f"WHEN length({norm}) >= 18 AND (({stereo} AND {marks} >= 1) OR ({marks} >= 3 AND ({complex_} OR {formula})) OR (length({norm}) >= 60 AND {marks} >= 2)) THEN 4 ELSE 5 END"
    )


RULES = "['empty_alias', 'short_acronym_alias', 'clinical_code_alias', 'short_alias', 'technical_chemical_alias', 'clinical_alias']"

RAW_SQL = f"""
    WITH tk AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({FOLD.format("text")}, '[a-z]{{5,}}')) AS tok FROM documents),
    vocab AS (SELECT tok, row_number() OVER (ORDER BY df DESC, tok) AS r FROM (SELECT tok, count(*) AS df FROM tk GROUP BY tok) WHERE 50 * df >= (SELECT count(*) FROM documents)),
    ahead AS (SELECT *, lead(tok, 1) OVER w AS t1, lead(tok, 2) OVER w AS t2, lead(tok, 3) OVER w AS t3, lead(tok, 4) OVER w AS t4 FROM vocab WINDOW w AS (ORDER BY r)),
    syn AS (SELECT (r - 1) // 4 AS seq, tok AS ingredient_it, CASE WHEN (r - 1) // 4 % 2 = 0 THEN upper(t1) END AS ingredient_en,
                   ['active', 'inactive', 'active/inactive'][(r - 1) // 4 % 3 + 1] AS entity_type,
                   list_filter([t2, concat_ws(' ', tok, t2)], lambda x: x IS NOT NULL) AS synonyms_it, list_filter([t3, t4], lambda x: x IS NOT NULL) AS synonyms_en
            FROM ahead WHERE r % 4 = 1),
    pt AS (SELECT p.*, coalesce(tok, 'nothing') AS tok FROM part p LEFT JOIN vocab ON r = p_partkey % greatest((SELECT count(*) FROM vocab), 1) + 1),
    drug AS (SELECT p_partkey AS seq, CAST(p_partkey AS VARCHAR) AS drug_code, CASE WHEN p_partkey % 7 = 3 THEN upper(tok) WHEN p_partkey % 5 = 0 THEN upper(p_brand) ELSE upper(p_name) END || '*' || p_size || 'CPR' AS drug_name,
                    p_type AS atc, string_split(CASE WHEN p_partkey % 7 = 3 THEN tok WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '#') || '#' || tok ELSE replace(p_name, ' ', '#') END, '#') AS compositions, [p_type] AS excipients
             FROM pt)
"""

KB_SQL = RAW_SQL + f""",
    syn_id AS (SELECT *, replace(entity_type, '/', '_') || ':' || {sql_id("ingredient_it")} AS cid FROM syn),
    syn_raw AS (SELECT seq * 1000 + k AS seq, n.raw AS alias_raw, cid AS target_id, 'ingredient' AS target_type, n.lang AS language, 'UMLS' AS source, n.prio AS priority FROM (
        SELECT seq, cid, unnest(names) AS n, unnest(range(len(names))) AS k FROM (SELECT seq, cid, list_concat(list_concat(
            [{{'raw': ingredient_it, 'lang': 'it', 'prio': 95}}, {{'raw': ingredient_en, 'lang': 'en', 'prio': 90}}], list_transform(synonyms_it, lambda x: {{'raw': x, 'lang': 'it', 'prio': 80}})),
            list_transform(synonyms_en, lambda x: {{'raw': x, 'lang': 'en', 'prio': 75}})) AS names FROM syn_id)) WHERE n.raw IS NOT NULL),
    syn_norm AS (SELECT *, {sql_norm("alias_raw")} AS alias_normalized FROM syn_raw),
    ing AS (SELECT alias_normalized, min(target_id) AS concept_id FROM syn_norm GROUP BY alias_normalized HAVING count(DISTINCT target_id) = 1),
    parts AS (SELECT seq, drug_code, 'active' AS role, unnest(range(len(compositions))) AS pos, unnest(compositions) AS name FROM drug
              UNION ALL SELECT seq, drug_code, 'inactive', unnest(range(len(excipients))), unnest(excipients) FROM drug),
    resolved AS (SELECT p.*, coalesce(concept_id, role || ':' || {sql_id("name")}) AS concept_id, concept_id IS NULL AS created FROM parts p LEFT JOIN ing ON alias_normalized = {sql_norm("name")}),
    concept_rows AS (SELECT CAST(seq AS DOUBLE) AS seq, cid AS concept_id, entity_type, ingredient_it AS canonical_it, ingredient_en AS canonical_en, 'UMLS' AS source FROM syn_id
        UNION ALL SELECT 1e9 + seq * 1000 + CASE role WHEN 'active' THEN 0 ELSE 500 END + pos / 1000, concept_id, role, name, NULL, 'AIFA' FROM resolved WHERE created),
    concepts AS (SELECT concept_id, arg_min(entity_type, seq) AS entity_type, arg_min(canonical_it, seq) AS canonical_it, arg_min(canonical_en, seq) FILTER (canonical_en IS NOT NULL) AS canonical_en, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM concept_rows GROUP BY concept_id),
    products AS (SELECT d.seq, 'drug:aic:' || d.drug_code AS product_id, d.drug_code, d.drug_name, trim(split_part(d.drug_name, '*', 1)) AS brand_name,
        (SELECT list_sort(list(DISTINCT concept_id)) FROM resolved r WHERE r.seq = d.seq AND role = 'active') AS actives, (SELECT list_sort(list(DISTINCT concept_id)) FROM resolved r WHERE r.seq = d.seq AND role = 'inactive') AS excipient_ids FROM drug d),
    alias_rows AS (SELECT CAST(seq AS DOUBLE) AS seq, alias_raw, target_id, target_type, language, source, priority FROM syn_norm
        UNION ALL SELECT 1e12 + seq * 1000 + CASE role WHEN 'active' THEN 0 ELSE 500 END + pos / 1000, name, concept_id, 'ingredient', 'it', 'AIFA', 90 FROM resolved WHERE created
        UNION ALL SELECT 2e15 + seq * 2, drug_name, product_id, 'drug_product', 'it', 'AIFA', 90 FROM products
        UNION ALL SELECT 2e15 + seq * 2 + 1, brand_name, 'brand:' || {sql_id("brand_name")}, 'drug_brand', 'it', 'AIFA', 85 FROM products WHERE brand_name <> ''),
    alias_norm AS (SELECT *, {sql_norm("alias_raw")} AS alias_normalized FROM alias_rows),
    alias_one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias_normalized, target_id, target_type ORDER BY priority DESC, seq) AS rn,
        CASE WHEN priority > first_value(priority) OVER (PARTITION BY alias_normalized, target_id, target_type ORDER BY seq) THEN 'higher_priority_duplicate' END AS deduplicated_from FROM alias_norm WHERE alias_normalized <> '') WHERE rn = 1),
    alias_ambig AS (SELECT *, {sql_policy("alias_raw", "alias_normalized")} AS rule, (SELECT string_agg(DISTINCT o.target_id, ',' ORDER BY o.target_id) FROM alias_one o WHERE o.alias_normalized = a.alias_normalized AND o.target_type = a.target_type HAVING count(DISTINCT o.target_id) > 1) AS targets FROM alias_one a),
    aliases AS (SELECT *, {RULES}[rule + 1] AS policy_reason, CASE WHEN rule IN (2, 5) THEN 'clinical' WHEN rule = 4 THEN 'technical' ELSE 'unsafe' END AS alias_category,
        rule IN (2, 5) AND targets IS NULL AS safe, rule IN (1, 3) OR targets IS NOT NULL AS requires_context FROM alias_ambig),
    brands AS (SELECT 'brand:' || {sql_id("brand_name")} AS brand_id, arg_min(brand_name, seq) AS brand_name, string_agg(product_id, ',' ORDER BY product_id) AS product_ids, count(*) AS n_products,
        list_sort(list(DISTINCT actives) FILTER (len(actives) > 0)) AS sigs FROM products WHERE brand_name <> '' GROUP BY 1),
    brand_status AS (SELECT *, CASE WHEN sigs IS NULL OR len(sigs) <> 1 THEN 'ambiguous_brand' WHEN len(sigs[1]) = 1 THEN 'single_active_signature' ELSE 'multi_active_signature' END AS brand_status FROM brands)
"""
