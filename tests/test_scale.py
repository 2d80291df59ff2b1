"""What kept results whole at larger sizes: no step whose work or rows grow with the square of a group."""

import random

from conftest import rows

from termloom.config import FuzzyConfig
from termloom.functions.text import places, plain_text
from termloom.operators import exact, fuzzy, kb, notes, overlap, vectors
from termloom.plans import fixture
from termloom.sources import raw

SPAN = "note_id bigint, start int, end int"


def test_a_place_costs_lookups_by_length_not_by_alias():
    names = [f"ab {k:04}" for k in range(5000)] + ["ab", "+ab 17"]
    starts, found = [], []
    exact.finder(names)("ab 0017 xab 0018 +ab 17", starts, found)
    assert sorted(zip(starts, found)) == [(0, "ab"), (0, "ab 0017"), (17, "+ab 17"), (18, "ab")]


def test_targets_of_shared_names_are_stored_once(spark):
    syn = raw.clean_synonyms(spark.createDataFrame([], "seq bigint, ingredient_it string, ingredient_en string, type string, synonyms_it array<string>, synonyms_en array<string>"))
    drugs = raw.clean_drugs(spark.createDataFrame([(k, str(k), "SAME NAME*1CPR", "x", "y") for k in range(40)], "seq bigint, aic string, drug_name string, composition string, excipients string"))
    seen = {}
    made = kb.build(syn, drugs, stage=lambda df, name: seen.setdefault(name, df))
    assert "ambiguous_targets" not in seen["aliases"].columns
    assert [len(r.ambiguous_targets) for r in seen["shared"].collect()] == [40]
    assert [len(r.ambiguous_targets) for r in made.aliases.where("target_type = 'drug_product'").collect()] == [40] * 40
    # an ingredient that 40 products have is classified once
    assert seen["created"].count() == 2


def test_overlaps_against_brute_force(spark):
    random.seed(5)
    some = lambda n: [(random.randrange(3), a := random.randrange(900), a + random.choice((0, 1, 5, 300))) for _ in range(n)]
    a, b = sorted(set(some(150))), sorted(set(some(40)))
    hit = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    x, y = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    assert rows(overlap.overlap_pairs(x, y)) == sorted(((*p, *q[1:]) for p in a for q in b if hit(p, q)), key=repr)
    assert rows(overlap.without_overlap(x, y)) == sorted((p for p in a if not any(hit(p, q) for q in b)), key=repr)
    plan = overlap.without_overlap(x, y)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_notes_text_does_not_go_with_its_segments_and_words(spark):
    n = spark.createDataFrame([(1, "uno due tre-quattro paziente 12 lungaparola"), (2, None)], "note_id bigint, norm string")
    none = spark.createDataFrame([(1, 0, 3)], SPAN)
    tok = fuzzy.tokens(n, overlap.gaps(n, none))
    assert [tuple(r)[2:] for r in tok.orderBy("start").collect()][:2] == [(0, "due", 4, 7), (1, "tre-quattro", 8, 19)]
    assert ("due tre-quattro", 2) in {(r.text, r.token_count) for r in fuzzy.candidates(n, none, FuzzyConfig()).collect()}
    words = notes.original_words(spark.createDataFrame([(7, "Éa  ½b"), (8, None)], "note_id bigint, text string"), exact.HEAD)
    assert rows(words) == sorted([(7, "ea", 0, 0, "Éa"), (7, "1", 3, 4, "½"), (7, "2b", 5, 4, "½b")], key=repr)
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_places_without_a_python_step_for_each_character():
    assert plain_text("  E  171,  Ab ") == places("  E  171,  Ab ")[0] == "e171 ab"
    assert places("  E  171,  Ab ")[1].tolist() == [2, 5, 6, 7, 8, 11, 12]


def test_words_are_counted_before_they_are_dealt_out(spark):
    docs = spark.createDataFrame([(1, "alpha Alpha beta5 gammas"), (2, "alphà"), (3, None)], "doc_id bigint, text string").coalesce(1)
    assert rows(fixture.document_counts(docs)) == [("alpha", 2), ("gammas", 1)]


def test_blocks_of_queries_do_not_pass_through_the_driver(spark):
    index = spark.range(50).selectExpr("id AS vector_id", "array(cast(id AS float), 1f) AS vector")
    near = vectors.nearest(index.where("vector_id % 20 = 0").withColumnRenamed("vector_id", "query_id"), index, 2)
    assert near.count() == 6
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
