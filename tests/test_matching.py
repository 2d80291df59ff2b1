"""Exact matching, overlaps, the fuzzy and vector layers, whole notes."""

import random
import re
from dataclasses import replace

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from termloom.config import EngineConfig, FuzzyConfig, SemanticConfig
from termloom.functions import similarity
from termloom.operators import exact, fuzzy, notes, overlap, vectors
from termloom.schemas import ALIASES, CANDIDATES
from termloom.sources.tables import KnowledgeBase
from termloom.streaming.notes import standardize_stream

A = "alias_raw alias_normalized target_id target_type language source alias_category priority safe_for_exact_match requires_context policy_reason ambiguous_targets deduplicated_from".split()


def alias(norm, target="active:x", kind="ingredient", priority=80, safe=True, category="clinical", reason="clinical_alias"):
    return (norm, norm, target, kind, "it", "UMLS", category, priority, safe, False, reason, None, None)


def aliases(spark, *entries):
    return spark.createDataFrame(list(entries), ALIASES)


def note_frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "note_id long, norm string")


def test_exact_match_boundaries(spark):
    a = aliases(spark, alias("sodio"), alias("rosso", safe=False))
    got = rows(exact.match(note_frame(spark, "allergia a sodio", "allergia a disodio", "sodio-x sodio.", "rosso", ""), a).select("note_id", "start", "end"))
    assert got == [(0, 11, 16), (2, 8, 13)]
    assert exact.match(note_frame(spark, "rosso"), a, include_unsafe=True).count() == 1


@pytest.mark.parametrize("limit,piece", [(500_000, 64), (500_000, 2), (0, 64)])
def test_every_alias_against_brute_force(spark, monkeypatch, limit, piece):
    """Aliases of signs alone, leads, long ones; in pieces of any size, broadcast and shuffled."""
    monkeypatch.setattr(exact, "BROADCAST", limit)
    monkeypatch.setattr(exact, "PIECE", piece)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("ab-+.' ") for _ in range(n)).strip()
    texts = [" ".join(make(rng.randint(0, 40)).split()) for _ in range(120)] + ["", "+", "a+", "+a", ". .", "'", " ".join(["ab"] * 300)]
    names = sorted({x for x in (" ".join(make(rng.randint(1, 9)).split()) for _ in range(120)) if x} | {"+", ".", "+.", "' '", " ".join(["ab"] * 5)})
    got = rows(exact.match(note_frame(spark, *texts), aliases(spark, *(alias(n, n) for n in names))).select("note_id", "start", "end", "target_id"))
    edge = lambda c: not re.match("[a-z0-9_-]", c)
    expected = [(i, k, k + len(n), n) for i, x in enumerate(texts) for n in names for k in range(len(x)) if x.startswith(n, k) and (k == 0 or edge(x[k - 1])) and (k + len(n) == len(x) or edge(x[k + len(n)]))]
    assert got == sorted(expected, key=repr)


def test_exact_match_against_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("ab-+. ") for _ in range(n)).strip()
    texts = [" ".join(make(rng.randint(0, 25)).split()) for _ in range(150)]
    names = sorted({x for x in (" ".join(make(rng.randint(1, 5)).split()) for _ in range(60)) if re.search("[a-z0-9_-]", x)})
    got = rows(exact.match(note_frame(spark, *texts), aliases(spark, *(alias(n, n) for n in names))).select("note_id", "start", "target_id"))
    edge = lambda c: c == "" or not re.match("[a-z0-9_-]", c)
    expected = [(i, p, n) for i, x in enumerate(texts) for n in names for p in range(len(x)) if x.startswith(n, p) and edge(x[p - 1 : p] if p else "") and edge(x[p + len(n) : p + len(n) + 1])]
    assert got == sorted(expected, key=repr)


def cand(note, start, end, target="t", kind="ingredient", confidence=1.0, priority=80):
    return (note, "s", start, end, target, kind, "raw", "norm", "clinical", confidence, priority, "m", False)


def test_resolution_cases(spark):
    df = spark.createDataFrame([
        cand(0, 10, 18, "a"), cand(0, 10, 23, "b"), cand(1, 0, 3, "a"), cand(1, 3, 6, "b"), cand(2, 0, 5, "a", priority=90), cand(2, 0, 5, "b", "drug_brand", priority=80), cand(3, 0, 5, "a", priority=20), cand(3, 0, 5, "b", priority=90),
    ], CANDIDATES)
    assert rows(overlap.resolve(df).select("note_id", "target_id")) == [(0, "b"), (1, "a"), (1, "b"), (2, "b"), (3, "b")]


def test_resolution_against_plain_greedy(spark):
    rng = random.Random(9)
    data = [cand(n, s, s + rng.randint(1, 9), f"t{rng.randint(0, 3)}", rng.choice(["ingredient", "drug_brand"]), 1.0, rng.randint(0, 3)) for n in range(30) for s in [rng.randint(0, 60) for _ in range(20)]]
    got = rows(overlap.resolve(spark.createDataFrame(data, CANDIDATES)).select("note_id", "start", "end", "target_id"))
    expected = []
    for n in range(30):
        kept = []
        for c in sorted((c for c in data if c[0] == n), key=lambda c: (c[2] - c[3], -{"drug_brand": 2, "ingredient": 1}[c[5]], -c[10], c[2], c[4])):
            if all(c[3] <= k[2] or k[3] <= c[2] for k in kept):
                kept.append(c)
        expected += [(n, c[2], c[3], c[4]) for c in kept]
    assert got == sorted(expected, key=repr)


def test_gaps_and_layers(spark):
    n = note_frame(spark, "0123456789", "", "abc")
    spans = spark.createDataFrame([(0, 2, 4), (0, 3, 6), (0, 9, 10), (0, 7, 7)], "note_id long, start int, end int")
    assert rows(overlap.gaps(n, spans)) == [(0, 0, 2), (0, 6, 9), (2, 0, 3)]
    low = spark.createDataFrame([(0, 1, 3), (0, 6, 7)], "note_id long, start int, end int")
    assert rows(overlap.merge_layers(spans, low)) == rows(spans.union(low.where("start = 6")))


def test_candidates(spark):
    n = note_frame(spark, "allergia a sodio e acetaminofne 500 mg", "12345678", "di la il")
    done = spark.createDataFrame([(0, 11, 16)], "note_id long, start int, end int")
    got = {r.text for r in fuzzy.candidates(n, done).collect()}
    assert got == {"acetaminofne", "acetaminofne 500"}


def test_distances():
    assert similarity.osa("ca", "abc") == 3 and similarity.osa("ab", "ba") == 1 and similarity.osa("", "abc") == 3 and similarity.osa("acetaminofne", "acetaminofene") == 1
    assert similarity.sort_ratio("b a", "a b") == 1.0 and similarity.set_ratio("a b c", "a b") == 1.0 and similarity.set_ratio("", "a") == 0.0
    assert similarity.indel_ratio("abcd", "abxd") == pytest.approx(0.75) and similarity.common_subsequence("abcbdab", "bdcaba") == 4


def test_edit_join_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(4, 10)))
    texts, keys = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    got = rows(fuzzy.edit_join(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in keys], "key string")))
    assert got == sorted(((a, b, d) for a in texts for b in keys if (d := similarity.osa(a, b)) <= 2), key=repr)


def test_acceptance(spark):
    row = lambda text, target, score: (text, target, target, 80, 1, score)
    df = spark.createDataFrame([row("acetaminofne", "a", 0.92), row("acetaminofne", "b", 0.80), row("paracetamlo", "a", 0.70), row("ibuprofenee", "a", 0.92), row("ibuprofenee", "b", 0.90)], "text string, target_id string, alias_normalized string, priority int, distance int, score double")
    got = dict(rows(fuzzy.decide(df, FuzzyConfig().edit_acceptance).select("text", "reason")))
    assert got == {"acetaminofne": "accepted", "paracetamlo": "below_length_dependent_threshold", "ibuprofenee": "ambiguous_fuzzy_suggestion"}


def test_fuzzy_layer(spark):
    a = aliases(spark, alias("acetaminofene", "active:p"), alias("lisinopril didrato", "active:l"), alias("tachipirina", "brand:t", "drug_brand"))
    n = note_frame(spark, "reazione ad acetaminofne", "non tollera didrato lisinopril", "tachipirna", "acetaminofne acetaminofene")
    none = spark.createDataFrame([], "note_id long, start int, end int")
    got = rows(fuzzy.layer(n, none, a).select("note_id", "surface", "target_id", "method"))
    assert (0, "acetaminofne", "active:p", "symspell_fuzzy") in got and (1, "didrato lisinopril", "active:l", "ngram_rapidfuzz") in got
    assert not [x for x in got if x[0] == 2]
    with pytest.raises(ValueError):
        fuzzy.layer(n, none, a, FuzzyConfig(strategies=()))


def test_nearest_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(20, 5)), rng.normal(size=(70, 5))
    frame = lambda name, m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], f"{name} long, vector array<float>")
    got = {(r.query_id, r.rn): (r.vector_id, r.similarity) for r in vectors.nearest(frame("query_id", q), frame("vector_id", x), 3).collect()}
    sims = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    for i in range(20):
        for k, j in enumerate(np.argsort(-sims[i])[:3], 1):
            assert got[i, k][0] == j and got[i, k][1] == pytest.approx(sims[i, j], abs=1e-5)


def test_nearest_breaks_ties_by_id(spark):
    """Many equal vectors in one block, collected in falling order of their ids."""
    index = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40, 0, -1)] + [(0, [2.0, -1.0])], "vector_id long, vector array<float>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0, 2.0])], "query_id long, vector array<float>")
    assert [r.vector_id for r in vectors.nearest(asked, index, 5).orderBy("rn").collect()] == [1, 2, 3, 4, 5]


def test_entities(spark):
    n = note_frame(spark, "allergia a (sodio), rosso e febbre")
    e = spark.createDataFrame([(0, "B-DRUG", None, "x", 11, 19, 0.9), (0, None, "drug", "x", 20, 25, 0.9), (0, "DISEASE", None, "x", 28, 34, 0.9), (0, "DRUG", None, "x", 0, 2, 0.9)], "note_id long, entity_group string, entity string, word string, start int, end int, score double")
    protected = spark.createDataFrame([(0, 20, 25)], "note_id long, start int, end int")
    assert rows(vectors.entity_candidates(n, e, protected)) == [(0, 12, 17, "sodio")]


@pytest.fixture(scope="module")
def small_kb(spark):
    c = spark.createDataFrame([("active:p", "active", "Paracetamolo", "Paracetamol", ["UMLS"]), ("inactive:l", "inactive", "Lattosio", None, ["UMLS"])], "concept_id string, entity_type string, canonical_it string, canonical_en string, sources array<string>")
    p = spark.createDataFrame([("drug:aic:1", "1", "TACHI*20", "TACHI", ["active:p"], ["inactive:l"])], "product_id string, drug_code string, drug_name string, brand_name string, active_ingredient_ids array<string>, excipient_ids array<string>")
    b = spark.createDataFrame([("brand:tachipirina", "Tachipirina", "single_active_signature", ["active:p"], [["active:p"]]), ("brand:amplizer", "Amplizer", "ambiguous_brand", ["active:p"], [["active:p"], ["inactive:l"]])], "brand_id string, brand_name string, brand_status string, active_ingredient_ids array<string>, active_ingredient_signatures array<array<string>>")
    a = aliases(spark, alias("acetaminofene", "active:p"), alias("tachipirina", "brand:tachipirina", "drug_brand"), alias("amplizer", "brand:amplizer", "drug_brand"), alias("tachi 20", "drug:aic:1", "drug_product"), alias("perduto", "brand:lost", "drug_brand"))
    return KnowledgeBase(c, a, p, b, None, None)


NOTES = ["Allergia ad acetaminofene.", "Paziente allergico alla Tachipirina.", "Allergia ad AMPLIZER.", "TACHI (20) e perduto", None, "", "Reazione ad acetaminofne."]


def texts(spark):
    return spark.createDataFrame(list(enumerate(NOTES)), "note_id long, text string")


@pytest.mark.parametrize("policy,expected", [
    ("annotate", ["Allergia ad acetaminofene [Paracetamol].", "Paziente allergico alla Tachipirina [Paracetamol].", "Allergia ad AMPLIZER.", "TACHI (20 [Paracetamol]) e perduto", None, "", "Reazione ad acetaminofne [Paracetamol]."]),
    ("replace", ["Allergia ad Paracetamol.", "Paziente allergico alla Tachipirina [Paracetamol].", "Allergia ad AMPLIZER.", "TACHI (20 [Paracetamol]) e perduto", None, "", "Reazione ad Paracetamol."]),
    ("structured_only", NOTES),
])
def test_standardize(spark, small_kb, policy, expected):
    cfg = EngineConfig(note_output_policy=policy, fuzzy=FuzzyConfig(enabled=True))
    got = {r.note_id: r for r in notes.standardize(texts(spark), small_kb, cfg).collect()}
    assert [got[i].standardized_text for i in range(len(NOTES))] == expected
    assert got[2].num_ambiguous == 1 and got[2].num_matches == 0 and got[6].num_fallback_resolved_matches == 1
    assert {(m.target_id, m.status, m.reason) for m in got[3].matches} == {("drug:aic:1", "resolved", None), ("brand:lost", "unresolved", "missing_brand")}


def test_excipients_and_language(spark, small_kb):
    cfg = EngineConfig(include_excipients=True, output_language="it")
    got = {r.note_id: r for r in notes.standardize(texts(spark), small_kb, cfg).collect()}
    assert got[3].standardized_text == "TACHI (20 [Paracetamolo; Lattosio]) e perduto"


def test_semantic_layer(spark, small_kb):
    def fake(n, done):
        return n.where("norm = 'reazione ad acetaminofne.'").select("note_id", F.lit("acetaminofne").alias("surface"), F.lit(12).alias("start"), F.lit(24).alias("end"), F.lit("active:p").alias("target_id"), F.lit("ingredient").alias("target_type"), F.lit("x").alias("alias_raw"), F.lit("x").alias("alias_normalized"), F.lit("clinical").alias("alias_category"), F.lit(0.95).alias("confidence"), F.lit(55).alias("priority"), F.lit("semantic_embedding").alias("method"), F.lit(False).alias("requires_context"))

    got = {r.note_id: r for r in notes.standardize(texts(spark), small_kb, EngineConfig(), fake).collect()}
    assert got[6].standardized_text == "Reazione ad acetaminofne [Paracetamol]." and got[6].num_semantic_resolved_matches == 1


def test_semantic_acceptance(spark):
    row = lambda text, target, alias_, score: (text, target, alias_, 55, score)
    df = spark.createDataFrame([row("a", "x", "1", 0.95), row("a", "y", "2", 0.85), row("b", "x", "1", 0.70), row("c", "x", "1", 0.93), row("c", "y", "2", 0.91), row("d", "x", "1", 0.93), row("d", "x", "2", 0.92)], "text string, target_id string, alias_normalized string, priority int, score double")
    got = dict(rows(vectors.decide(df, SemanticConfig()).select("text", "reason")))
    assert got == {"a": "accepted", "b": "below_semantic_similarity_threshold", "c": "ambiguous_semantic_match", "d": "accepted"}
    assert dict(rows(vectors.decide(df, replace(SemanticConfig(), threshold=0.5)).select("text", "reason")))["b"] == "accepted"


def test_stream(spark, small_kb, tmp_path):
    texts(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("note_id long, text string").parquet(str(tmp_path / "in"))
    standardize_stream(stream, small_kb, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(NOTES)


def test_registered_functions(spark):
    similarity.register(spark)
    assert spark.sql("SELECT osa_distance('ab', 'ba'), term_normalize('È'), token_sort_ratio('a b', 'b a')").first()[0:3] == (1, "e", 1.0)
