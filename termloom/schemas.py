"""Table schemas and allowed values."""

# The names that entities, targets, languages, sources, categories and statuses may have.
ENTITY_TYPES = ("active", "inactive", "active/inactive")
TARGET_TYPES = ("ingredient", "drug_product", "drug_brand")
ALIAS_LANGUAGES = ("it", "en", "unknown")
ALIAS_SOURCES = ("AIFA", "UMLS", "DERIVED")
ALIAS_CATEGORIES = ("clinical", "technical", "unsafe")
BRAND_STATUSES = ("single_active_signature", "multi_active_signature", "ambiguous_brand")
SEVERITIES = ("info", "warning", "error")

SYNONYMS = "ingredient_it string, ingredient_en string, type string, synonyms_it array<string>, synonyms_en array<string>"
DRUGS = "drug_code string, drug_name string, atc string, drug_form string, compositions array<string>, excipients array<string>"
CONCEPTS = "concept_id string, entity_type string, canonical_it string, canonical_en string, sources array<string>"
ALIASES = (
    "alias_raw string, alias_normalized string, target_id string, target_type string, language string, source string, alias_category string, "
    "priority int, safe_for_exact_match boolean, requires_context boolean, policy_reason string, ambiguous_targets array<string>, deduplicated_from string"
)
PRODUCTS = (
    "product_id string, drug_code string, drug_name string, brand_name string, normalized_brand_name string, drug_form string, atc string, "
    "active_ingredient_ids array<string>, excipient_ids array<string>, source string, normalized_full_name string"
)
BRANDS = (
    "brand_id string, brand_name string, normalized_brand_name string, product_ids array<string>, active_ingredient_ids array<string>, "
    "active_ingredient_signatures array<array<string>>, brand_status string"
)
ISSUES = "severity string, code string, message string, item_id string, raw_name string, drug_code string"
REPORT = (
    "concepts_count bigint, aliases_count bigint, drug_products_count bigint, drug_brands_count bigint, ambiguous_aliases_count bigint, "
    "unsafe_short_aliases_count bigint, unresolved_product_ingredients_count bigint, ambiguous_brands_count bigint"
)
TABLES = {"concepts": CONCEPTS, "aliases": ALIASES, "drug_products": PRODUCTS, "drug_brands": BRANDS, "issues": ISSUES, "report": REPORT}
CANDIDATES = (
    "note_id bigint, surface string, start int, end int, target_id string, target_type string, alias_raw string, alias_normalized string, "
    "alias_category string, confidence double, priority int, method string, requires_context boolean"
)
