"""Raw sources, the knowledge base, storage, inspection."""

import json

import pytest
from pyspark.sql import functions as F

from termloom.operators import inspection, kb
from termloom.sources import raw, tables

SYNONYMS = [
    {"ingredient_it": "paracetamolo", "ingredient_en": "Paracetamol", "type": "active", "synonyms_it": ["Acetaminofene", "APAP", None, " "], "synonyms_en": ["Acetaminophen"]},
    {"ingredient_it": "Alcool etilico", "ingredient_en": None, "type": "active/inactive", "synonyms_it": None, "synonyms_en": ["Ethanol"]},
]
CSV = '''aic,denominazione,atc,composition,excipients
012345678,TACHIPIRINA*20CPR 500MG,N02BE01,Paracetamolo,Lattosio monoidrato#Alcool etilico
000000002,TACHIPIRINA*10CPR 1G,NA,Acetaminofene,
000000003,"AMPLIZER*30CPR, ""R""",J01,Alfa base,
000000004,AMPLIZER*10CPR,J01,Beta base#Paracetamolo,
'''


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    (d / "s.json").write_text(json.dumps(SYNONYMS))
    (d / "d.csv").write_text(CSV)
    return kb.build(raw.read_synonyms(spark, str(d / "s.json")), raw.read_drugs(spark, str(d / "d.csv")))


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text(CSV)
    got = {r.drug_code: r for r in raw.read_drugs(spark, str(tmp_path / "d.csv")).collect()}
    assert got["012345678"].excipients == ["Lattosio monoidrato", "Alcool etilico"] and got["000000002"].atc is None and got["000000003"].drug_name == 'AMPLIZER*30CPR, "R"'
    (tmp_path / "bad.csv").write_text("aic,name\n,x\n")
    with pytest.raises(Exception, match="drug_code is blank"):
        raw.read_drugs(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "bad.json").write_text('[{"ingredient_it": "x", "type": "other"}]')
    with pytest.raises(Exception, match="unknown entity type"):
        raw.read_synonyms(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "broken.json").write_text('[{"ingredient_it": 3, ')
    with pytest.raises(Exception):
        raw.read_synonyms(spark, str(tmp_path / "broken.json")).collect()


def test_concepts_and_issues(built):
    ids = {r.concept_id: r for r in built.concepts.collect()}
    assert set(ids) == {"active:paracetamolo", "active_inactive:alcool_etilico", "inactive:lattosio_monoidrato", "active:alfa_base", "active:beta_base"}
    assert ids["active:paracetamolo"].canonical_en == "Paracetamol"
    assert sorted(r.item_id for r in built.issues.collect()) == ["active:alfa_base", "active:beta_base", "inactive:lattosio_monoidrato"]


def test_aliases(built):
    a = {(r.alias_normalized, r.target_id): r for r in built.aliases.collect()}
    assert ("acetaminofene", "active:paracetamolo") in a and ("tachipirina", "brand:tachipirina") in a
    assert not a["apap", "active:paracetamolo"].safe_for_exact_match and a["apap", "active:paracetamolo"].requires_context
    # the English spelling has the same normal form as nothing else; the Italian one wins by priority
    assert a["paracetamolo", "active:paracetamolo"].priority == 95
    assert built.aliases.groupBy("alias_normalized", "target_id", "target_type").count().where("count > 1").isEmpty()


def test_products_and_brands(built):
    p = {r.drug_code: r for r in built.drug_products.collect()}
    assert p["012345678"].active_ingredient_ids == ["active:paracetamolo"] and p["012345678"].excipient_ids == ["active_inactive:alcool_etilico", "inactive:lattosio_monoidrato"]
    b = {r.brand_id: r for r in built.drug_brands.collect()}
    assert b["brand:tachipirina"].brand_status == "single_active_signature" and b["brand:tachipirina"].product_ids == ["drug:aic:000000002", "drug:aic:012345678"]
    assert b["brand:amplizer"].brand_status == "ambiguous_brand"


def test_ambiguity_and_dedup(spark):
    rows = [(0.0, "A", "a", "t1", "ingredient", "it", "UMLS", "clinical", 80, True, False, "clinical_alias"), (1.0, "a", "a", "t1", "ingredient", "en", "UMLS", "clinical", 95, True, False, "clinical_alias"), (2.0, "a", "a", "t2", "ingredient", "it", "UMLS", "clinical", 80, True, False, "clinical_alias"), (3.0, "a", "a", "b1", "drug_brand", "it", "AIFA", "clinical", 85, True, False, "clinical_alias")]
    df = spark.createDataFrame(rows, "seq double, alias_raw string, alias_normalized string, target_id string, target_type string, language string, source string, alias_category string, priority int, safe_for_exact_match boolean, requires_context boolean, policy_reason string")
    got = {r.target_id: r for r in kb.mark_ambiguous(kb.dedup_aliases(df)).collect()}
    assert got["t1"].priority == 95 and got["t1"].deduplicated_from == "higher_priority_duplicate" and got["t2"].deduplicated_from is None
    assert got["t1"].ambiguous_targets == ["t1", "t2"] and not got["t1"].safe_for_exact_match and got["b1"].safe_for_exact_match


def test_storage_report_and_validation(spark, built, tmp_path):
    for fmt in ("json", "parquet"):
        tables.write_kb(built, str(tmp_path / fmt), fmt)
        again = tables.read_kb(spark, str(tmp_path / fmt), fmt)
        assert sorted(map(str, again.aliases.collect())) == sorted(map(str, built.aliases.collect()))
        assert again.report.first() == built.report.first()
    tables.write_report(built.report, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["concepts_count"] == 5
    assert {r.violations for r in kb.validate(built).collect()} == {0}
    bad = spark.createDataFrame([("x:1", "active", "n", None, ["UMLS"])], built.concepts.schema)
    assert {r.rule: r.violations for r in kb.validate(tables.KnowledgeBase(bad, built.aliases, built.drug_products, built.drug_brands, built.issues, built.report)).collect()}["concept_prefix"] == 1
    dup = spark.createDataFrame([("a", "x"), ("a", "y")], "id string, v string")
    assert [tuple(r) for r in tables.unique(dup, "id").collect()] == [("a", "y")]


def test_inspection(built):
    assert inspection.search(built, "TACHIPIRINA").where("kind = 'drug_product'").count() == 2
    assert inspection.search(built, "paracetamol", 1).groupBy("kind").count().agg(F.max("count")).first()[0] == 1
    assert {(r.value, r.n) for r in inspection.brand_summary(built).collect()} == {("single_active_signature", 1), ("ambiguous_brand", 1)}
    assert inspection.largest_brands(built, 1).count() == 1 and inspection.longest_technical(built).count() == 0


def test_empty_inputs(spark):
    syn = raw.clean_synonyms(spark.createDataFrame([], "seq long, ingredient_it string, ingredient_en string, type string, synonyms_it array<string>, synonyms_en array<string>"))
    drugs = raw.clean_drugs(spark.createDataFrame([], "seq long, aic string, name string"))
    assert tuple(kb.build(syn, drugs).report.first()) == (0,) * 8
