"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows.

Columns are flat: arrays as comma-joined text, doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.config import EngineConfig, FuzzyConfig
from termloom.functions import policy, similarity
from termloom.functions import text as t
from termloom.operators import exact, fuzzy, inspection, kb, notes, overlap, vectors
from termloom.plans import fixture
from termloom.plans.fixture import KB_SQL, RAW_SQL, sql_id, sql_norm, table
from termloom.sources import raw, tables
from termloom.sources.staging import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


def norm_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.normalized(fixture.notes(spark, sf_dir))


def fixture_kb(spark: SparkSession, sf_dir: str):
    return fixture.knowledge_base(spark, sf_dir)


# --- scalar text functions and sources -------------------------------------------------------------------


@query(f"SELECT doc_id AS note_id, {sql_norm('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return fixture.notes(spark, sf_dir).select("note_id", t.normalize(F.col("text")).alias("norm"))


@query(f"SELECT page_id, {fixture.FOLD.format('html')} AS folded FROM pages")
def fold_accents(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.fold(F.col("html")).alias("folded"))


@query("SELECT p_partkey, regexp_replace('colour e ' || (100 + p_partkey % 1000) || ', e' || p_size || ' and se 171', '(?i)\\b(e)\\s+(\\d{3,4})\\b', '\\1\\2', 'g') AS joined FROM part")
def normalize_enumbers(spark, sf_dir):
    text = F.concat(F.lit("colour e "), (100 + F.col("p_partkey") % 1000).cast("string"), F.lit(", e"), F.col("p_size").cast("string"), F.lit(" and se 171"))
    return table(spark, sf_dir, "part").select("p_partkey", t.normalize_e_numbers(text).alias("joined"))


@query(f"SELECT conv_id, turn, {sql_id('text')} AS id FROM conversations")
def normalize_for_id(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.normalize_for_id(F.col("text")).alias("id"))


@query(RAW_SQL + f"SELECT seq, drug_name AS full_name, trim(split_part(drug_name, '*', 1)) AS base_name, {sql_norm('drug_name')} AS norm_full, {sql_norm(chr(116) + 'rim(split_part(drug_name, ' + chr(39) + '*' + chr(39) + ', 1))')} AS norm_base FROM drug")
def parse_drug_name(spark, sf_dir):
    name = F.col("drug_name")
    return fixture.drugs(spark, sf_dir).select("seq", name.alias("full_name"), t.base_name(name).alias("base_name"), t.normalize(name).alias("norm_full"), t.normalize(t.base_name(name)).alias("norm_base"))


@query("""
    SELECT p_partkey, p_type, coalesce(CASE WHEN p_partkey % 3 > 0 THEN nullif(trim(p_brand || ' '), '') END, nullif(trim(p_name), '')) AS name FROM part
""")
def coalesce_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("drug_name", F.when(F.col("p_partkey") % 3 > 0, F.concat("p_brand", F.lit(" "))).otherwise("  ")).withColumn("denominazione", F.col("p_name"))
    return p.select("p_partkey", "p_type", raw.first_available(p, raw.DRUG_COLUMNS["drug_name"]).alias("name"))


@query("""
    SELECT p_partkey, list_aggregate(list_filter(list_transform(string_split(' ' || p_name || '# #' || p_type || ' #', '#'), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ',') AS parts FROM part
""")
def split_hash_list(spark, sf_dir):
    text = F.concat(F.lit(" "), F.col("p_name"), F.lit("# #"), F.col("p_type"), F.lit(" #"))
    return table(spark, sf_dir, "part").select("p_partkey", joined(raw.split_hash_list(text)).alias("parts"))


@query("""
    SELECT p_partkey AS seq, f.field FROM (SELECT p_partkey, unnest([{'field': 'drug_code', 'bad': p_partkey % 11 = 0}, {'field': 'drug_name', 'bad': p_size = 7}]) AS f FROM part) WHERE f.bad
""")
def validate_raw(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey").cast("string")).alias("drug_code"), F.when(F.col("p_size") == 7, "  ").otherwise(F.col("p_name")).alias("drug_name"))
    return raw.violations(rows, ("drug_code", "drug_name"))


@query(RAW_SQL + "SELECT ingredient_it, ingredient_en, entity_type, array_to_string(synonyms_it, ',') AS synonyms_it, array_to_string(synonyms_en, ',') AS synonyms_en FROM syn")
def scan_synonyms(spark, sf_dir):
    """The synonym rows written as one JSON array and scanned back."""
    path = f"{shared_dir(spark)}/raw-synonyms-{id(object())}"
    rows = fixture.raw_synonyms(fixture.vocabulary(spark, sf_dir)).drop("seq")
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.mode("overwrite").text(path)
    return raw.read_synonyms(spark, path).drop("seq").select("ingredient_it", "ingredient_en", "entity_type", joined("synonyms_it").alias("synonyms_it"), joined("synonyms_en").alias("synonyms_en"))


@query(RAW_SQL + "SELECT drug_code, drug_name, atc, array_to_string(compositions, ',') AS compositions, array_to_string(excipients, ',') AS excipients FROM drug")
def scan_drugs(spark, sf_dir):
    """The drug rows written as CSV and scanned back."""
    path = f"{shared_dir(spark)}/raw-drugs-{id(object())}"
    fixture.raw_drugs(table(spark, sf_dir, "part"), fixture.vocabulary(spark, sf_dir)).drop("seq").coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return raw.read_drugs(spark, path).drop("seq").select("drug_code", "drug_name", "atc", joined("compositions").alias("compositions"), joined("excipients").alias("excipients"))


@query()
def original_span(spark, sf_dir):
    """Every run of word characters of every note in both coordinate systems."""
    return notes.original_words(fixture.notes(spark, sf_dir), exact.HEAD)


@query(RAW_SQL + """, c AS (SELECT r, tok, CASE WHEN r % 2 = 0 THEN tok || ' ' || lead(tok) OVER (ORDER BY r) ELSE tok END AS text FROM vocab), d AS (SELECT r, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS c FROM c WHERE text IS NOT NULL)
    SELECT r, list_aggregate(list_sort(list_distinct(list_transform(range(1, greatest(length(c) - 2, 1) + 1), lambda i: substr(c, i, 3)))), 'string_agg', ',') AS grams FROM d""")
def char_ngrams(spark, sf_dir):
    from pyspark.sql import Window

    v = fixture.vocabulary(spark, sf_dir)
    pair = F.concat(F.col("tok"), F.lit(" "), F.lead("tok").over(Window.orderBy("r")))
    return v.select("r", F.when(F.col("r") % 2 == 0, pair).otherwise(F.col("tok")).alias("text")).where("text IS NOT NULL").select("r", joined(F.array_sort(t.char_ngrams(F.col("text")))).alias("grams"))


# --- knowledge base --------------------------------------------------------------------------------------


@query(KB_SQL + "SELECT concept_id, entity_type, canonical_it, canonical_en, sources FROM concepts")
def build_concepts(spark, sf_dir):
    return fixture.build(spark, sf_dir).concepts.withColumn("sources", joined("sources"))


ALIAS_SQL = "SELECT alias_raw, alias_normalized, target_id, target_type, language, source, alias_category, CAST(priority AS INTEGER) AS priority, safe AS safe_for_exact_match, requires_context, policy_reason, targets AS ambiguous_targets, deduplicated_from FROM aliases"


@query(KB_SQL + ALIAS_SQL)
def build_aliases(spark, sf_dir):
    return fixture.build(spark, sf_dir).aliases.withColumn("ambiguous_targets", joined("ambiguous_targets"))


@query(KB_SQL + "SELECT alias_normalized, concept_id FROM ing")
def ingredient_index(spark, sf_dir):
    return kb.ingredient_index(kb.synonym_aliases(fixture.synonyms(spark, sf_dir), EngineConfig()))


@query(KB_SQL + "SELECT seq, role, CAST(pos AS INTEGER) AS pos, name, concept_id, created FROM resolved")
def resolve_ingredients(spark, sf_dir):
    index = kb.ingredient_index(kb.synonym_aliases(fixture.synonyms(spark, sf_dir), EngineConfig()))
    return kb.resolve_ingredients(fixture.drugs(spark, sf_dir), index, EngineConfig()).drop("drug_code")


@query(KB_SQL + "SELECT 'info' AS severity, 'created_missing_' || role || '_concept' AS code, concept_id AS item_id, name AS raw_name, drug_code FROM resolved WHERE created")
def build_issues(spark, sf_dir):
    return fixture_kb(spark, sf_dir).issues.drop("message")


@query(KB_SQL + "SELECT product_id, drug_code, drug_name, brand_name, list_aggregate(actives, 'string_agg', ',') AS actives, list_aggregate(excipient_ids, 'string_agg', ',') AS excipients FROM products")
def build_products(spark, sf_dir):
    p = fixture_kb(spark, sf_dir).drug_products
    return p.select("product_id", "drug_code", "drug_name", "brand_name", joined("active_ingredient_ids").alias("actives"), joined("excipient_ids").alias("excipients"))


@query(KB_SQL + "SELECT brand_id, brand_name, product_ids, brand_status, list_aggregate(list_sort(list_distinct(flatten(sigs))), 'string_agg', ',') AS actives, CAST(len(sigs) AS INTEGER) AS n_signatures FROM brand_status")
def build_brands(spark, sf_dir):
    b = fixture_kb(spark, sf_dir).drug_brands
    return b.select("brand_id", "brand_name", joined("product_ids").alias("product_ids"), "brand_status", joined("active_ingredient_ids").alias("actives"), F.size("active_ingredient_signatures").alias("n_signatures"))


@query(KB_SQL + "SELECT alias_normalized, target_id, target_type, alias_raw, CAST(priority AS INTEGER) AS priority, deduplicated_from FROM alias_one")
def dedup_aliases(spark, sf_dir):
    a = fixture_kb(spark, sf_dir).aliases
    return a.select("alias_normalized", "target_id", "target_type", "alias_raw", "priority", "deduplicated_from")


@query(KB_SQL + "SELECT alias_normalized, target_id, targets FROM aliases WHERE targets IS NOT NULL")
def mark_ambiguous(spark, sf_dir):
    a = fixture_kb(spark, sf_dir).aliases.where("ambiguous_targets IS NOT NULL")
    return a.select("alias_normalized", "target_id", joined("ambiguous_targets").alias("targets"))


@query(KB_SQL + f"""SELECT alias_raw, {fixture.RULES}[rule + 1] AS reason, CASE WHEN rule IN (2, 5) THEN 'clinical' WHEN rule = 4 THEN 'technical' ELSE 'unsafe' END AS category, rule IN (2, 5) AS safe, rule IN (1, 3) AS context
    FROM (SELECT alias_raw, {fixture.sql_policy('alias_raw', 'alias_normalized')} AS rule FROM (
        SELECT alias_raw, {sql_norm('alias_raw')} AS alias_normalized FROM (SELECT unnest([drug_name, 'E ' || seq % 2000, '(R)-' || seq || '-' || drug_name || '-[x]', upper(left(drug_name, 4)), left(drug_name, 3)]) AS alias_raw FROM drug)))""")
def alias_policy(spark, sf_dir):
    name, seq = F.col("drug_name"), F.col("seq").cast("string")
    forms = F.array(name, F.concat(F.lit("E "), (F.col("seq") % 2000).cast("string")), F.concat(F.lit("(R)-"), seq, F.lit("-"), name, F.lit("-[x]")), F.upper(F.substring(name, 1, 4)), F.substring(name, 1, 3))
    rows = fixture.drugs(spark, sf_dir).select(F.explode(forms).alias("alias_raw"))
    p = policy.classify(F.col("alias_raw"), t.normalize(F.col("alias_raw")))
    return rows.withColumn("p", p).select("alias_raw", F.col("p.reason").alias("reason"), F.col("p.category").alias("category"), F.col("p.safe").alias("safe"), F.col("p.requires_context").alias("context"))


REPORT_SQL = """SELECT (SELECT count(*) FROM concepts) AS concepts_count, (SELECT count(*) FROM aliases) AS aliases_count, (SELECT count(*) FROM products) AS drug_products_count, (SELECT count(*) FROM brands) AS drug_brands_count,
    (SELECT count(*) FROM aliases WHERE targets IS NOT NULL) AS ambiguous_aliases_count, (SELECT count(*) FROM aliases WHERE policy_reason = 'short_alias') AS unsafe_short_aliases_count,
    (SELECT count(*) FROM resolved WHERE created) AS unresolved_product_ingredients_count, (SELECT count(*) FROM brand_status WHERE brand_status = 'ambiguous_brand') AS ambiguous_brands_count"""


@query(KB_SQL + REPORT_SQL)
def build_report(spark, sf_dir):
    return fixture_kb(spark, sf_dir).report


@query(KB_SQL + REPORT_SQL)
def build_kb(spark, sf_dir):
    """The whole build, anew, down to the report."""
    return fixture.build(spark, sf_dir).report


@query(KB_SQL + """,
    bad_c AS (SELECT CASE WHEN length(canonical_it) % 3 = 0 THEN 'x' || concept_id ELSE concept_id END AS concept_id, entity_type, CASE WHEN length(canonical_it) % 7 = 0 THEN ' ' ELSE canonical_it END AS canonical_it FROM concepts),
    bad_a AS (SELECT CASE WHEN length(alias_raw) % 9 = 0 THEN '' ELSE target_id END AS target_id, alias_raw, alias_normalized, priority + CASE WHEN length(alias_raw) % 4 = 0 THEN 50 ELSE 0 END AS priority FROM aliases),
    bad_p AS (SELECT CASE WHEN drug_code LIKE '%7' THEN drug_code ELSE product_id END AS product_id, CASE WHEN drug_code LIKE '%3' THEN NULL ELSE drug_code END AS drug_code, drug_name FROM products),
    bad_b AS (SELECT CASE WHEN length(brand_name) % 5 = 0 THEN brand_name ELSE brand_id END AS brand_id, CASE WHEN length(brand_name) % 6 = 0 THEN '' ELSE brand_name END AS brand_name FROM brands)
    SELECT 'concept_blank' AS rule, count(*) FILTER (trim(concept_id) = '' OR trim(canonical_it) = '') AS violations FROM bad_c
    UNION ALL SELECT 'concept_prefix', count(*) FILTER (NOT starts_with(concept_id, replace(entity_type, '/', '_') || ':')) FROM bad_c
    UNION ALL SELECT 'alias_blank', count(*) FILTER (trim(alias_raw) = '' OR trim(alias_normalized) = '' OR trim(target_id) = '') FROM bad_a
    UNION ALL SELECT 'alias_priority', count(*) FILTER (priority NOT BETWEEN 0 AND 100) FROM bad_a
    UNION ALL SELECT 'product_blank', count(*) FILTER (coalesce(trim(drug_code), '') = '' OR trim(drug_name) = '') FROM bad_p
    UNION ALL SELECT 'product_prefix', count(*) FILTER (NOT starts_with(product_id, 'drug:aic:')) FROM bad_p
    UNION ALL SELECT 'brand_blank', count(*) FILTER (trim(brand_id) = '' OR trim(brand_name) = '') FROM bad_b
    UNION ALL SELECT 'brand_prefix', count(*) FILTER (NOT starts_with(brand_id, 'brand:')) FROM bad_b""")
def validate_kb(spark, sf_dir):
    """The constraints counted over tables in which some rows of each kind are broken."""
    k = fixture_kb(spark, sf_dir)
    size = lambda c, n: F.length(c) % n == 0
    broken = lambda bad, value, c: F.when(bad, value).otherwise(F.col(c))
    concepts = k.concepts.select(broken(size("canonical_it", 3), F.concat(F.lit("x"), "concept_id"), "concept_id").alias("concept_id"), "entity_type", broken(size("canonical_it", 7), F.lit(" "), "canonical_it").alias("canonical_it"))
    aliases = k.aliases.select(broken(size("alias_raw", 9), F.lit(""), "target_id").alias("target_id"), "alias_raw", "alias_normalized", (F.col("priority") + F.when(size("alias_raw", 4), 50).otherwise(0)).alias("priority"))
    products = k.drug_products.select(broken(F.endswith("drug_code", F.lit("7")), F.col("drug_code"), "product_id").alias("product_id"), broken(F.endswith("drug_code", F.lit("3")), F.lit(None), "drug_code").alias("drug_code"), "drug_name")
    brands = k.drug_brands.select(broken(size("brand_name", 5), F.col("brand_name"), "brand_id").alias("brand_id"), broken(size("brand_name", 6), F.lit(""), "brand_name").alias("brand_name"))
    return kb.validate(tables.KnowledgeBase(concepts, aliases, products, brands, k.issues, k.report))


@query(KB_SQL + ALIAS_SQL)
def kb_roundtrip(spark, sf_dir):
    """The tables written as JSON lines, read with their schemas."""
    folder = f"{shared_dir(spark)}/kb-{id(object())}"
    tables.write_kb(fixture_kb(spark, sf_dir), folder, "json")
    return tables.read_kb(spark, folder, "json").aliases.withColumn("ambiguous_targets", joined("ambiguous_targets"))


@query(KB_SQL + "SELECT a.alias_raw, a.target_id, canonical_it, drug_name, brand_status FROM aliases a LEFT JOIN concepts ON a.target_id = concept_id LEFT JOIN products ON a.target_id = product_id LEFT JOIN brand_status ON a.target_id = brand_id")
def kb_lookup(spark, sf_dir):
    k = fixture_kb(spark, sf_dir)
    a = k.aliases.select("alias_raw", "target_id")
    a = a.join(k.concepts.select(F.col("concept_id").alias("target_id"), "canonical_it"), "target_id", "left").join(k.drug_products.select(F.col("product_id").alias("target_id"), "drug_name"), "target_id", "left")
    return a.join(k.drug_brands.select(F.col("brand_id").alias("target_id"), "brand_status"), "target_id", "left").select("alias_raw", "target_id", "canonical_it", "drug_name", "brand_status")


# --- matching and resolution -----------------------------------------------------------------------------

EXACT_SQL = KB_SQL + f""",
    notes AS (SELECT doc_id AS note_id, text, {sql_norm('text')} AS norm FROM documents),
    hits AS (SELECT note_id, norm, a.*, string_split(norm, alias_normalized) AS ps FROM notes JOIN (SELECT * FROM aliases WHERE safe) a ON contains(norm, alias_normalized)),
    pos AS (SELECT * EXCLUDE (ps), unnest(list_transform(range(1, len(ps)), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * length(alias_normalized) AS INTEGER))) AS s FROM hits),
    exact AS MATERIALIZED (SELECT *, s + length(alias_normalized) AS e FROM pos WHERE (s = 0 OR NOT regexp_matches(substr(norm, s, 1), '[a-z0-9_-]')) AND (s + length(alias_normalized) = length(norm) OR NOT regexp_matches(substr(norm, s + length(alias_normalized) + 1, 1), '[a-z0-9_-]')))
"""
RESOLVED_SQL = EXACT_SQL + """,
    ranked AS (SELECT note_id, list({'s': s, 'e': e, 'id': target_id, 'raw': alias_raw, 'kind': target_type} ORDER BY s - e, CASE target_type WHEN 'drug_product' THEN 0 WHEN 'drug_brand' THEN 1 ELSE 2 END, -priority, s, target_id, alias_raw) AS l FROM exact GROUP BY note_id),
    greedy AS (SELECT note_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x.s < y.e AND y.s < x.e)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0])) AS m FROM ranked),
    resolved_spans AS MATERIALIZED (SELECT note_id, m.s AS s, m.e AS e, m.id AS target_id, m.raw AS alias_raw, m.kind AS target_type FROM greedy)
"""


def exact_matches(spark, sf_dir) -> DataFrame:
    return exact.match(norm_notes(spark, sf_dir), fixture_kb(spark, sf_dir).aliases)


@query(EXACT_SQL + 'SELECT note_id, s AS start, CAST(e AS INTEGER) AS "end", target_id, target_type, alias_raw FROM exact')
def exact_match(spark, sf_dir):
    return exact_matches(spark, sf_dir).select("note_id", "start", "end", "target_id", "target_type", "alias_raw")


@query(RESOLVED_SQL + 'SELECT note_id, s AS start, CAST(e AS INTEGER) AS "end", target_id, target_type, alias_raw FROM resolved_spans')
def resolve_overlaps(spark, sf_dir):
    return overlap.resolve(exact_matches(spark, sf_dir)).select("note_id", "start", "end", "target_id", "target_type", "alias_raw")


@query(RESOLVED_SQL + "SELECT target_id, target_type, count(*) AS mentions, count(DISTINCT note_id) AS notes FROM resolved_spans GROUP BY ALL")
def mention_counts(spark, sf_dir):
    found = overlap.resolve(exact_matches(spark, sf_dir))
    return found.groupBy("target_id", "target_type").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("note_id").alias("notes"))


TOKEN_SQL = RESOLVED_SQL + """,
    cand AS (SELECT note_id, s, e FROM exact GROUP BY ALL)
"""


@query(TOKEN_SQL + 'SELECT a.note_id, a.s AS start, CAST(a.e AS INTEGER) AS "end", b.s AS other_start, CAST(b.e AS INTEGER) AS other_end FROM cand a JOIN resolved_spans b ON a.note_id = b.note_id AND a.s < b.e AND b.s < a.e')
def interval_overlap(spark, sf_dir):
    found = staged(exact_matches(spark, sf_dir), "candidates")
    return overlap.overlap_pairs(found.select("note_id", "start", "end").distinct(), overlap.resolve(found))


@query(RESOLVED_SQL + """, hi AS (SELECT * FROM resolved_spans WHERE target_type <> 'ingredient'), lo AS (SELECT note_id, s, e, target_id FROM exact WHERE target_type = 'ingredient'),
    taken AS (SELECT note_id, list({'s': s, 'e': e}) AS spans FROM hi GROUP BY note_id)
    SELECT note_id, s AS start, CAST(e AS INTEGER) AS "end", target_id FROM hi
    UNION ALL SELECT note_id, s, CAST(e AS INTEGER), target_id FROM lo LEFT JOIN taken USING (note_id) WHERE coalesce(len(list_filter(spans, lambda x: x.s < lo.e AND lo.s < x.e)), 0) = 0""")
def merge_layers(spark, sf_dir):
    found = staged(exact_matches(spark, sf_dir), "candidates")
    cols = ["note_id", "start", "end", "target_id"]
    return overlap.merge_layers(overlap.resolve(found).where("target_type <> 'ingredient'").select(cols), found.where("target_type = 'ingredient'").select(cols))


GAP_SQL = RESOLVED_SQL + """,
    marks AS (SELECT note_id, s, e FROM resolved_spans UNION ALL SELECT note_id, length(norm), length(norm) FROM notes),
    gap0 AS (SELECT note_id, coalesce(max(e) OVER (PARTITION BY note_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, s FROM marks),
    gaps AS (SELECT note_id, CAST(g AS INTEGER) AS gs, CAST(s AS INTEGER) AS ge FROM gap0 WHERE s > g)
"""


@query(GAP_SQL + 'SELECT note_id, gs AS start, ge AS "end" FROM gaps')
def residual_segments(spark, sf_dir):
    return overlap.gaps(*protected_notes(spark, sf_dir))


# --- fuzzy layer -----------------------------------------------------------------------------------------

FUZZY_SQL = GAP_SQL + r""",
    tile0 AS (SELECT note_id, gs, regexp_extract_all(substr(norm, gs + 1, ge - gs), '[a-z0-9]+(?:[+\-''][a-z0-9]+)*|[^a-z0-9]+') AS rs FROM gaps JOIN notes USING (note_id)),
    tile1 AS (SELECT note_id, gs, unnest(rs) AS run, unnest(range(len(rs))) AS i FROM tile0),
    tile2 AS (SELECT *, gs + coalesce(sum(length(run)) OVER (PARTITION BY note_id, gs ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tile1),
    toks AS (SELECT note_id, gs, row_number() OVER (PARTITION BY note_id, gs ORDER BY i) - 1 AS idx, run AS token, s, s + length(run) AS e FROM tile2 WHERE regexp_matches(run, '^[a-z0-9]'))
"""


def protected_notes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = staged(norm_notes(spark, sf_dir), "norm")
    return n, staged(overlap.resolve(exact.match(n, fixture_kb(spark, sf_dir).aliases)), "resolved")


@query(FUZZY_SQL + 'SELECT note_id, gs AS segment, CAST(idx AS INTEGER) AS idx, token, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM toks')
def fuzzy_tokens(spark, sf_dir):
    n, done = protected_notes(spark, sf_dir)
    return fuzzy.tokens(n, overlap.gaps(n, done))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in fuzzy.STOPWORDS) + ")"


@query(FUZZY_SQL + f""",
    wins AS (SELECT a.note_id, a.gs, a.idx, k.k, min(b.idx) FILTER (b.token NOT IN {STOP_SQL}) AS f, max(b.idx) FILTER (b.token NOT IN {STOP_SQL}) AS l, count(*) AS n
             FROM toks a, (SELECT unnest([1, 2, 3, 4]) AS k) k JOIN toks b ON b.note_id = a.note_id AND b.gs = a.gs AND b.idx BETWEEN a.idx AND a.idx + k.k - 1 GROUP BY ALL HAVING count(*) = k.k),
    trimmed AS (SELECT DISTINCT w.note_id, w.gs, w.f, w.l FROM wins w WHERE f IS NOT NULL),
    spans AS (SELECT t.note_id, a.s, b.e, CAST(t.l - t.f + 1 AS INTEGER) AS token_count FROM trimmed t JOIN toks a ON a.note_id = t.note_id AND a.gs = t.gs AND a.idx = t.f JOIN toks b ON b.note_id = t.note_id AND b.gs = t.gs AND b.idx = t.l
              WHERE EXISTS (SELECT 1 FROM toks c WHERE c.note_id = t.note_id AND c.gs = t.gs AND c.idx BETWEEN t.f AND t.l AND c.token NOT IN {STOP_SQL} AND length(c.token) >= 3 AND NOT regexp_matches(c.token, '^[0-9]+$')))
    SELECT note_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", substr(norm, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS text, token_count FROM spans JOIN notes USING (note_id) WHERE length(replace(substr(norm, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), ' ', '')) >= 6""")
def fuzzy_candidates(spark, sf_dir):
    n, done = protected_notes(spark, sf_dir)
    return fuzzy.candidates(n, done)


ELIGIBLE_SQL = KB_SQL + ", eligible AS (SELECT * FROM aliases WHERE target_type = 'ingredient' AND safe AND policy_reason = 'clinical_alias')"
KEY_SQL = "replace(regexp_replace(trim(trim(trim({0}), '.,;:!?()[]{{}}')), '\\s+', ' ', 'g'), ' ', '_')"


@query(ELIGIBLE_SQL + "SELECT alias_raw, alias_normalized, target_id FROM eligible")
def fuzzy_eligible(spark, sf_dir):
    return fuzzy.eligible(fixture_kb(spark, sf_dir).aliases).select("alias_raw", "alias_normalized", "target_id")


@query(ELIGIBLE_SQL + "SELECT alias_normalized, target_id FROM eligible GROUP BY ALL")
def semantic_eligible(spark, sf_dir):
    return vectors.select_for_index(fixture_kb(spark, sf_dir).aliases).select("alias_normalized", "target_id")


@query(ELIGIBLE_SQL + f"SELECT {KEY_SQL.format('alias_normalized')} AS key, CAST(greatest(max(priority), 1) AS INTEGER) AS weight, count(*) AS n_aliases FROM eligible GROUP BY 1")
def edit_dictionary(spark, sf_dir):
    return fuzzy.edit_dictionary(fixture_kb(spark, sf_dir).aliases)


TEXT_SQL = ELIGIBLE_SQL + """,
    mis0 AS (SELECT tok, lead(tok, 2) OVER (ORDER BY r) AS nxt FROM vocab),
    mis AS (SELECT DISTINCT text FROM (SELECT unnest([substr(tok, 1, 2) || substr(tok, 4), substr(tok, 1, 2) || substr(tok, 4, 1) || substr(tok, 3, 1) || substr(tok, 5), concat_ws(' ', nxt, tok)]) AS text FROM mis0) WHERE length(text) >= 6)
"""
#: The optimal string alignment of lists of characters a and b, row by row: rows of the last two characters, and the character before.
OSA_SQL = """list_reduce(range(1, len(a) + 1), lambda st, i: {'old': st.now, 'now': list_reduce(range(1, len(b) + 1), lambda r, j: list_append(r, least(st.now[j + 1] + 1, r[j] + 1, st.now[j] + CASE WHEN a[i] = b[j] THEN 0 ELSE 1 END,
    CASE WHEN i > 1 AND j > 1 AND a[i] = b[j - 1] AND a[i - 1] = b[j] THEN st.old[j - 1] + 1 ELSE 1000000 END)), [i])}, {'old': range(0, len(b) + 1), 'now': range(0, len(b) + 1)}).now[len(b) + 1]"""
#: SQL's own distance lets an edit stand between two swapped letters, so it is at most the one meant here, and finds the pairs.
NEAR_SQL = TEXT_SQL + f""",
    near0 AS MATERIALIZED (SELECT text, key FROM mis, (SELECT DISTINCT {KEY_SQL.format('alias_normalized')} AS key FROM eligible) WHERE abs(length(text) - length(key)) <= 2 AND damerau_levenshtein(replace(text, ' ', '_'), key) <= 2),
    near1 AS MATERIALIZED (SELECT * FROM (SELECT text, key, {OSA_SQL} AS distance FROM (SELECT text, key, string_split(replace(text, ' ', '_'), '') AS a, string_split(key, '') AS b FROM near0)) WHERE distance <= 2)"""


def misspelt(spark, sf_dir) -> DataFrame:
    return fixture.misspelt(fixture.vocabulary(spark, sf_dir))


@query(NEAR_SQL + " SELECT text, key, CAST(distance AS INTEGER) AS distance FROM near1")
def edit_join(spark, sf_dir):
    """Pairs within two edits."""
    return fuzzy.edit_join(misspelt(spark, sf_dir), fuzzy.edit_dictionary(fixture_kb(spark, sf_dir).aliases))


SCORE_SQL = ", scored AS (SELECT text, alias_raw, target_id, priority, alias_normalized, distance, greatest(0.0, 1.0 - distance / CAST(greatest(length(replace(text, ' ', '')), length(replace(alias_normalized, ' ', '')), 1) AS DOUBLE)) AS score FROM near1 JOIN eligible ON key = " + KEY_SQL.format("alias_normalized") + ")"


@query(NEAR_SQL + SCORE_SQL + "SELECT text, alias_normalized, target_id, CAST(distance AS INTEGER) AS distance, round(score, 6) AS score FROM scored")
def edit_suggestions(spark, sf_dir):
    """All suggestions within two edits, scored."""
    return fuzzy.edit_suggestions(misspelt(spark, sf_dir), fixture_kb(spark, sf_dir).aliases).select("text", "alias_normalized", "target_id", "distance", F.round("score", 6).alias("score"))


def near_suggestions(spark, sf_dir) -> DataFrame:
    return fuzzy.edit_suggestions(misspelt(spark, sf_dir), fixture_kb(spark, sf_dir).aliases)


@query(NEAR_SQL + SCORE_SQL + "SELECT text, alias_raw, target_id, round(score, 6) AS score, CAST(greatest(0, round_even((1.0 - score) * greatest(length(replace(text, ' ', '')), length(replace(alias_normalized, ' ', '')), 1), 0)) AS INTEGER) AS pseudo FROM scored")
def edit_score(spark, sf_dir):
    s = near_suggestions(spark, sf_dir)
    return s.select("text", "alias_raw", "target_id", F.round("score", 6).alias("score"), t.pseudo_distance(F.col("score"), F.col("text"), F.col("alias_normalized")).alias("pseudo"))


@query(NEAR_SQL + SCORE_SQL + """,
    rk AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, distance, priority DESC, alias_normalized, target_id) AS rn FROM scored),
    best AS (SELECT * FROM rk WHERE rn = 1),
    riv AS (SELECT b.text, max(r.score) AS rival FROM best b JOIN rk r ON r.text = b.text AND r.rn <= 5 AND r.target_id <> b.target_id GROUP BY b.text)
    SELECT b.text, b.target_id, round(score, 6) AS score, CASE WHEN score < CASE WHEN length(replace(b.text, ' ', '')) <= 8 THEN 0.95 WHEN length(replace(b.text, ' ', '')) <= 14 THEN 0.90 ELSE 0.86 END THEN 'below_length_dependent_threshold'
        WHEN coalesce(score - rival < CAST(0.05 AS DOUBLE), false) THEN 'ambiguous_fuzzy_suggestion' ELSE 'accepted' END AS reason FROM best b LEFT JOIN riv USING (text)""")
def fuzzy_accept(spark, sf_dir):
    return fuzzy.decide(near_suggestions(spark, sf_dir), FuzzyConfig().edit_acceptance).select("text", "target_id", F.round("score", 6).alias("score"), "reason")


BLOCK_SQL = TEXT_SQL + """,
    grams AS (SELECT text, list_distinct(list_transform(range(1, greatest(length(c) - 2, 1) + 1), lambda i: substr(c, i, 3))) AS g FROM (SELECT text, replace(text, ' ', '') AS c FROM mis)),
    agrams AS (SELECT alias_raw, alias_normalized, target_id, priority, list_distinct(list_transform(range(1, greatest(length(c) - 2, 1) + 1), lambda i: substr(c, i, 3))) AS g FROM (SELECT *, regexp_replace(alias_normalized, '[^a-z0-9]', '', 'g') AS c FROM eligible)),
    tg AS (SELECT text, len(g) AS tn, unnest(g) AS gram FROM grams), ag AS (SELECT * EXCLUDE (g), len(g) AS an, unnest(g) AS gram FROM agrams),
    cnt AS (SELECT text, alias_raw, alias_normalized, target_id, any_value(priority) AS priority, count(*) AS shared, count(*) / CAST(least(any_value(tn), any_value(an)) AS DOUBLE) AS overlap FROM tg JOIN ag USING (gram) GROUP BY 1, 2, 3, 4),
    blk AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY shared DESC, overlap DESC, priority DESC, alias_normalized, target_id, alias_raw) AS rn FROM cnt WHERE shared >= 2 AND overlap >= CAST(0.35 AS DOUBLE))"""


@query(BLOCK_SQL + "SELECT text, alias_raw, target_id, shared, round(overlap, 6) AS overlap FROM blk WHERE rn <= 100")
def trigram_block(spark, sf_dir):
    return fuzzy.trigram_block(misspelt(spark, sf_dir), fixture_kb(spark, sf_dir).aliases).select("text", "alias_raw", "target_id", "shared", F.round("overlap", 6).alias("overlap"))


INFO_SQL = f"list_distinct(list_filter(regexp_extract_all({{0}}, '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN {STOP_SQL}))"


@query(TEXT_SQL + f""", pairs AS (SELECT a.text, b.text AS other, {INFO_SQL.format('a.text')} AS x, {INFO_SQL.format('b.text')} AS y FROM (SELECT unnest([tok || ' ' || t1, tok || ' della ' || t2, t1]) AS text, r FROM ahead WHERE t2 IS NOT NULL) a JOIN (SELECT tok || ' ' || t2 AS text, r FROM ahead WHERE t2 IS NOT NULL) b USING (r))
    SELECT text, other, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS dice FROM pairs""")
def token_dice(spark, sf_dir):
    p = phrases(spark, sf_dir)
    info = lambda c: t.informative_tokens(F.col(c), fuzzy.STOPWORDS)
    return p.select("text", "other", F.round(t.dice(info("text"), info("other")), 6).alias("dice"))


def phrases(spark, sf_dir) -> DataFrame:
    """(text, other): phrases of neighbouring words of the vocabulary, some with a stopword between."""
    from pyspark.sql import Window

    w = Window.orderBy("r")
    v = fixture.vocabulary(spark, sf_dir).select("tok", F.lead("tok", 1).over(w).alias("t1"), F.lead("tok", 2).over(w).alias("t2")).where("t2 IS NOT NULL")
    return v.select(F.explode(F.array(F.concat_ws(" ", "tok", "t1"), F.concat_ws(" della ", "tok", "t2"), F.col("t1"))).alias("text"), F.concat_ws(" ", "tok", "t2").alias("other"))


def indel_sql(x: str, y: str) -> str:
    """2 LCS / (|x| + |y|) of two texts, 1 for two empty ones, by rows of the longest common subsequence's table."""
    rows = f"list_reduce(string_split({x}, ''), lambda row, c: list_reduce(range(1, length({y}) + 1), lambda r, j: list_append(r, CASE WHEN c = {y}[j] THEN row[j] + 1 ELSE greatest(row[j + 1], r[j]) END), [0]), list_transform(range(0, length({y}) + 1), lambda k: 0))"
    return f"CASE WHEN length({x}) + length({y}) = 0 THEN 1.0 WHEN length({x}) * length({y}) = 0 THEN 0.0 ELSE 2.0 * {rows}[length({y}) + 1] / (length({x}) + length({y})) END"


PHRASE_SQL = TEXT_SQL + ", phrases AS (SELECT a.text, b.text AS other FROM (SELECT unnest([tok || ' ' || t1, tok || ' della ' || t2, t1]) AS text, r FROM ahead WHERE t2 IS NOT NULL) a JOIN (SELECT tok || ' ' || t2 AS text, r FROM ahead WHERE t2 IS NOT NULL) b USING (r))"


def ratios_sql(source: str) -> str:
    """CTEs that add sort_ratio and set_ratio to the rows of `source`, which has the texts text and other."""
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
    return f""",
    rat0 AS (SELECT *, {words('text')} AS xs, {words('other')} AS ys, list_distinct({words('text')}) AS xd, list_distinct({words('other')}) AS yd FROM {source}),
    rat1 AS (SELECT * EXCLUDE (xd, yd), array_to_string(list_sort(xs), ' ') AS xsort, array_to_string(list_sort(ys), ' ') AS ysort, len(xd) AS nx, len(yd) AS ny,
        array_to_string(list_sort(list_intersect(xd, yd)), ' ') AS common, array_to_string(list_sort(list_filter(xd, lambda w: NOT list_contains(yd, w))), ' ') AS left_own, array_to_string(list_sort(list_filter(yd, lambda w: NOT list_contains(xd, w))), ' ') AS right_own FROM rat0),
    rat2 AS (SELECT *, trim(common || ' ' || left_own) AS with_x, trim(common || ' ' || right_own) AS with_y FROM rat1),
    ratios AS (SELECT * EXCLUDE (xs, ys), {indel_sql('xsort', 'ysort')} AS sort_ratio, CASE WHEN nx = 0 OR ny = 0 THEN 0.0 WHEN common <> '' AND (left_own = '' OR right_own = '') THEN 1.0
        WHEN common = '' THEN {indel_sql('with_x', 'with_y')} ELSE greatest({indel_sql('with_x', 'with_y')}, {indel_sql('common', 'with_x')}, {indel_sql('common', 'with_y')}) END AS set_ratio FROM rat2)
"""


@query(PHRASE_SQL + ratios_sql("phrases") + "SELECT text, other, round(sort_ratio, 6) AS ratio FROM ratios")
def token_sort_ratio(spark, sf_dir):
    return phrases(spark, sf_dir).select("text", "other", F.round(similarity.token_sort_ratio("text", "other"), 6).alias("ratio"))


@query(PHRASE_SQL + ratios_sql("phrases") + "SELECT text, other, round(set_ratio, 6) AS ratio FROM ratios")
def token_set_ratio(spark, sf_dir):
    return phrases(spark, sf_dir).select("text", "other", F.round(similarity.token_set_ratio("text", "other"), 6).alias("ratio"))


@query(BLOCK_SQL + f""",
    info AS (SELECT text, alias_normalized AS other, alias_raw, target_id, {INFO_SQL.format('text')} AS x, {INFO_SQL.format('alias_normalized')} AS y FROM blk WHERE rn <= 100),
    gated AS MATERIALIZED (SELECT * FROM (SELECT text, other, alias_raw, target_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / CAST(len(x) + len(y) AS DOUBLE) END AS dice FROM info) WHERE dice >= CAST(0.75 AS DOUBLE))"""
    + ratios_sql("gated") + """
    SELECT text, alias_raw, target_id, round(dice, 6) AS dice, round(greatest(sort_ratio, set_ratio) * dice, 6) AS score,
        CAST(greatest(0, round_even((1.0 - greatest(sort_ratio, set_ratio) * dice) * greatest(length(replace(text, ' ', '')), length(replace(other, ' ', '')), 1), 0)) AS INTEGER) AS distance FROM ratios""")
def fuzzy_score(spark, sf_dir):
    s = fuzzy.ratio_suggestions(misspelt(spark, sf_dir), fixture_kb(spark, sf_dir).aliases)
    return s.select("text", "alias_raw", "target_id", F.round("dice", 6).alias("dice"), F.round("score", 6).alias("score"), "distance")


@query()
def fuzzy_layer(spark, sf_dir):
    n, done = protected_notes(spark, sf_dir)
    return fuzzy.layer(n, done, fixture_kb(spark, sf_dir).aliases).select("note_id", "start", "end", "surface", "target_id", "method", F.round("confidence", 6).alias("confidence"))


# --- semantic layer --------------------------------------------------------------------------------------


def all_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnsRenamed({"embedding": "vector", "vec_id": "vector_id"}).withColumn("target_id", F.col("label").cast("string"))


def asked_vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every row whose vec_id is divisible by 20, as the queries, and all rows as the index."""
    e = all_vectors(spark, sf_dir)
    return e.where("vector_id % 20 = 0").withColumnRenamed("vector_id", "query_id").drop("target_id"), e


KNN_SQL = """
    WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS vector_id, i.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS sim FROM embeddings q JOIN embeddings i ON q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vector_id) AS rn FROM p)
"""


@query(KNN_SQL + "SELECT query_id, vector_id, round(sim, 4) AS similarity, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 10")
def knn_cosine(spark, sf_dir):
    queries, index = asked_vectors(spark, sf_dir)
    return vectors.nearest(queries, index).withColumn("similarity", F.round("similarity", 4))


@query(KNN_SQL + """, b AS (SELECT * FROM r WHERE rn = 1), v AS (SELECT b.query_id, max(r.sim) AS rival FROM b JOIN r ON r.query_id = b.query_id AND r.rn <= 10 AND r.label <> b.label GROUP BY 1)
    SELECT query_id, CAST(label AS VARCHAR) AS target_id, CASE WHEN sim < 0.35 THEN 'below_semantic_similarity_threshold' WHEN coalesce(sim - rival < CAST(0.04 AS DOUBLE), false) THEN 'ambiguous_semantic_match' ELSE 'accepted' END AS reason FROM b LEFT JOIN v USING (query_id)""")
def semantic_accept(spark, sf_dir):
    from dataclasses import replace

    queries, index = asked_vectors(spark, sf_dir)
    found = vectors.nearest(queries, index).join(index.drop("vector"), "vector_id").select("query_id", F.col("similarity").alias("score"), F.lit(55).alias("priority"), "target_id", F.lpad(F.col("vector_id").cast("string"), 20, "0").alias("alias_normalized"))
    cfg = replace(EngineConfig().semantic, threshold=0.35)
    return vectors.decide(found, cfg, "query_id").select("query_id", "target_id", "reason")


@query("SELECT vec_id AS vector_id, CAST(label AS VARCHAR) AS target_id, CAST(len(embedding) AS INTEGER) AS dim, (SELECT count(*) FROM embeddings) AS count FROM embeddings")
def vec_index_roundtrip(spark, sf_dir):
    """All rows of embeddings, written as an index and read back."""
    folder = f"{shared_dir(spark)}/vectors-{id(object())}"
    tables.write_vectors(all_vectors(spark, sf_dir), folder, "none")
    index, about = tables.read_vectors(spark, folder)
    return index.select("vector_id", "target_id", F.size("vector").alias("dim")).withColumn("count", F.lit(about["count"]))


def hashed_encoder(texts: DataFrame) -> DataFrame:
    """A stand-in encoder: 32 hashed n-gram counts."""
    slots = F.transform(t.char_ngrams(F.col("text")), lambda g: F.pmod(F.xxhash64(g), F.lit(32)).cast("int"))
    return texts.withColumn("s", slots).select("text", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.size(F.filter("s", lambda x: x == i)).cast("float")).alias("vector"))


def capital_entities(n: DataFrame) -> DataFrame:
    """A stand-in recogniser: every word of nine letters or more is a DRUG, with a bracket to trim; others aren't reported."""
    words = exact.word_starts(n, 1).where(F.length("head") >= 9)
    return words.select("note_id", F.lit("B-DRUG").alias("entity_group"), F.lit(None).cast("string").alias("entity"), F.col("head").alias("word"), (F.col("start") - 1).alias("start"), (F.col("start") + F.length("head") + 1).alias("end"), F.lit(1.0).alias("score"))


@query(RESOLVED_SQL + r""",
    run0 AS (SELECT note_id, norm, regexp_extract_all(norm, '[a-z0-9_-]+|[^a-z0-9_-]+') AS rs FROM notes),
    run1 AS (SELECT note_id, norm, unnest(rs) AS run, unnest(range(len(rs))) AS i FROM run0),
    run2 AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM run1),
    ent0 AS (SELECT note_id, greatest(s - 1, 0) AS a, least(s + length(run) + 1, length(norm)) AS b, norm FROM run2 WHERE regexp_matches(run, '^[a-z0-9_-]') AND length(run) >= 9),
    ent1 AS (SELECT note_id, a, substr(norm, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS piece FROM ent0),
    ent2 AS (SELECT note_id, a + length(piece) - length(ltrim(piece)) AS a, trim(piece) AS piece FROM ent1),
    ent3 AS (SELECT DISTINCT note_id, CAST(a + length(piece) - length(ltrim(piece, '.,;:!?()[]{}')) AS INTEGER) AS s, trim(piece, '.,;:!?()[]{}') AS text FROM ent2),
    taken AS (SELECT note_id, list({'s': s, 'e': e}) AS spans FROM resolved_spans GROUP BY note_id)
    SELECT note_id, s AS start, CAST(s + length(text) AS INTEGER) AS "end", text FROM ent3 LEFT JOIN taken USING (note_id)
    WHERE length(replace(text, ' ', '')) >= 3 AND coalesce(len(list_filter(spans, lambda x: x.s < ent3.s + length(text) AND ent3.s < x.e)), 0) = 0""")
def ner_filter(spark, sf_dir):
    n, done = protected_notes(spark, sf_dir)
    return vectors.entity_candidates(n, capital_entities(n), done)


@query()
def semantic_layer(spark, sf_dir):
    n, done = protected_notes(spark, sf_dir)
    index = staged(vectors.build_index(fixture_kb(spark, sf_dir).aliases, hashed_encoder), "index")
    return vectors.layer(n, done, index, capital_entities, hashed_encoder).select("note_id", "start", "end", "surface", "target_id", F.round("confidence", 4).alias("confidence"))


# --- notes -----------------------------------------------------------------------------------------------

ENRICH_SQL = RESOLVED_SQL + """,
    comp AS (SELECT concept_id AS target_id, 'ingredient' AS target_type, 'resolved' AS status, coalesce(nullif(canonical_en, ''), canonical_it) AS names FROM concepts
        UNION ALL SELECT product_id, 'drug_product', 'resolved', (SELECT string_agg(n, '; ' ORDER BY k) FROM (SELECT coalesce(nullif(canonical_en, ''), canonical_it) AS n, min(list_position(actives, concept_id)) AS k FROM concepts WHERE list_contains(actives, concept_id) GROUP BY 1)) FROM products
        UNION ALL SELECT brand_id, 'drug_brand', CASE brand_status WHEN 'ambiguous_brand' THEN 'ambiguous' ELSE 'resolved' END, CASE WHEN brand_status <> 'ambiguous_brand' THEN (SELECT string_agg(n, '; ' ORDER BY k) FROM (SELECT coalesce(nullif(canonical_en, ''), canonical_it) AS n, min(list_position(list_sort(flatten(sigs)), concept_id)) AS k FROM concepts WHERE list_contains(flatten(sigs), concept_id) GROUP BY 1)) END FROM brand_status),
    enriched AS (SELECT r.*, c.status, c.names FROM resolved_spans r LEFT JOIN comp c USING (target_id, target_type))
"""


@query(ENRICH_SQL + 'SELECT note_id, s AS start, CAST(e AS INTEGER) AS "end", target_id, status, names AS annotation FROM enriched')
def enrich_mentions(spark, sf_dir):
    k = fixture_kb(spark, sf_dir)
    return notes.enrich(overlap.resolve(exact_matches(spark, sf_dir)), notes.components(k)).select("note_id", "start", "end", "target_id", "status", "annotation")


@query(KB_SQL + "SELECT concept_id, coalesce(nullif(canonical_en, ''), canonical_it) AS en, canonical_it AS it FROM concepts")
def display_names(spark, sf_dir):
    c = fixture_kb(spark, sf_dir).concepts
    return c.select("concept_id", t.display_name("en", F.col("canonical_it"), F.col("canonical_en")).alias("en"), t.display_name("it", F.col("canonical_it"), F.col("canonical_en")).alias("it"))


@query(ENRICH_SQL + """,
    parts_of AS (SELECT note_id, s, e, CASE WHEN names IS NULL THEN '' ELSE ' [' || names || ']' END AS note, coalesce(lag(e) OVER (PARTITION BY note_id ORDER BY s), 0) AS p FROM enriched WHERE status <> 'ambiguous'),
    body AS (SELECT note_id, string_agg(substr(norm, CAST(p + 1 AS BIGINT), CAST(e - p AS BIGINT)) || note, '' ORDER BY s) AS out, max(e) AS last FROM parts_of JOIN notes USING (note_id) GROUP BY note_id)
    SELECT note_id, coalesce(out, '') || substr(norm, CAST(coalesce(last, 0) + 1 AS BIGINT)) AS rendered FROM notes LEFT JOIN body USING (note_id)""")
def render_notes(spark, sf_dir):
    """The normalised notes with their mentions annotated."""
    n, done = protected_notes(spark, sf_dir)
    m = notes.enrich(done, notes.components(fixture_kb(spark, sf_dir))).where("status <> 'ambiguous'")
    lists = m.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "target_type", "annotation"))).alias("mentions"))
    return n.join(lists, "note_id", "left").select("note_id", notes.render(F.col("norm"), F.col("mentions"), "annotate").alias("rendered"))


@query(ENRICH_SQL + """, c AS (SELECT note_id, count(*) AS n FROM exact GROUP BY 1), m AS (SELECT note_id, count(*) AS r, count(*) FILTER (coalesce(status, '') <> 'ambiguous') AS m, count(*) FILTER (status = 'ambiguous') AS a FROM enriched GROUP BY 1)
    SELECT note_id, coalesce(n, 0) AS num_exact_candidates, coalesce(r, 0) AS num_exact_resolved_matches, coalesce(r, 0) AS num_resolved_matches, coalesce(m, 0) AS num_matches, coalesce(a, 0) AS num_ambiguous FROM notes LEFT JOIN c USING (note_id) LEFT JOIN m USING (note_id)""")
def note_counters(spark, sf_dir):
    k = fixture_kb(spark, sf_dir)
    n = staged(norm_notes(spark, sf_dir), "norm")
    final, stages = notes.match_layers(n, k)
    return notes.counters(n, stages, notes.enrich(final, notes.components(k))).select("note_id", "num_exact_candidates", "num_exact_resolved_matches", "num_resolved_matches", "num_matches", "num_ambiguous")


@query()
def standardize_notes(spark, sf_dir):
    """The whole engine with the fuzzy layer: structured counts and the annotated text."""
    cfg = EngineConfig(fuzzy=FuzzyConfig(enabled=True))
    out = notes.standardize(fixture.notes(spark, sf_dir), fixture_kb(spark, sf_dir), cfg)
    return out.select("note_id", "standardized_text", F.size("matches").alias("n_matches"), F.size("ambiguous").alias("n_ambiguous"), *notes.COUNTERS)


# --- inspection ------------------------------------------------------------------------------------------


@query(KB_SQL + "SELECT 'entity_type' AS measure, entity_type AS value, count(*) AS n FROM concepts GROUP BY 2 UNION ALL SELECT 'concepts', 'all', count(*) FROM concepts")
def inspect_concepts(spark, sf_dir):
    return inspection.concept_summary(fixture_kb(spark, sf_dir))


@query(KB_SQL + "SELECT m AS measure, v AS value, count(*) AS n FROM (SELECT unnest([{'m': 'safe', 'v': CAST(safe AS VARCHAR)}, {'m': 'alias_category', 'v': alias_category}, {'m': 'target_type', 'v': target_type}, {'m': 'policy_reason', 'v': policy_reason}, {'m': 'ambiguous', 'v': CAST(targets IS NOT NULL AS VARCHAR)}], recursive := true) FROM aliases) GROUP BY 1, 2")
def inspect_aliases(spark, sf_dir):
    return inspection.alias_summary(fixture_kb(spark, sf_dir))


@query(KB_SQL + "SELECT alias_raw, alias_normalized, target_id, targets FROM aliases WHERE targets IS NOT NULL")
def inspect_ambiguous(spark, sf_dir):
    return inspection.ambiguous_aliases(fixture_kb(spark, sf_dir))


@query(KB_SQL + "SELECT alias_raw, target_id FROM aliases WHERE alias_category = 'technical' ORDER BY length(alias_raw) DESC, alias_raw, target_id LIMIT 20")
def inspect_technical(spark, sf_dir):
    return inspection.longest_technical(fixture_kb(spark, sf_dir))


@query(KB_SQL + "SELECT 'brand_status' AS measure, brand_status AS value, count(*) AS n FROM brand_status GROUP BY 2")
def inspect_brands(spark, sf_dir):
    return inspection.brand_summary(fixture_kb(spark, sf_dir))


@query(KB_SQL + "SELECT brand_name, n_products, brand_status FROM brand_status ORDER BY n_products DESC, brand_id LIMIT 20")
def inspect_largest_brands(spark, sf_dir):
    return inspection.largest_brands(fixture_kb(spark, sf_dir))


@query(KB_SQL + "SELECT 'created_missing_' || role || '_concept' AS code, concept_id AS item_id, name AS raw_name, count(*) AS n FROM resolved WHERE created GROUP BY ALL")
def inspect_issues(spark, sf_dir):
    return inspection.created_issues(fixture_kb(spark, sf_dir))


@query(KB_SQL + f"""SELECT 'alias' AS kind, target_id AS id, alias_raw AS name FROM aliases WHERE contains(alias_normalized, 'brand') OR contains(lower(alias_raw), 'brand')
    UNION ALL SELECT 'concept', concept_id, canonical_it FROM concepts WHERE contains({sql_norm('canonical_it')}, 'brand') OR contains({sql_norm('canonical_en')}, 'brand') OR contains(concept_id, 'brand')
    UNION ALL SELECT 'drug_product', product_id, drug_name FROM products WHERE contains({sql_norm('drug_name')}, 'brand') OR contains({sql_norm('brand_name')}, 'brand')
    UNION ALL SELECT 'drug_brand', brand_id, brand_name FROM brands WHERE contains({sql_norm('brand_name')}, 'brand') OR contains(lower(brand_name), 'brand')""")
def search_kb(spark, sf_dir):
    return inspection.search(fixture_kb(spark, sf_dir), "Brand")
