"""Assembly from a configuration, pluggable matchers, metadata, SQL functions, the last of repeated ids."""

import ctypes
import json
import os
import resource
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom import cli, engine
from termloom.config import EngineConfig, PathsConfig, SemanticConfig, from_mapping
from termloom.functions import similarity
from termloom.operators import kb, notes
from termloom.schemas import CANDIDATES
from termloom.sources import raw, staging, tables


def letters(texts):
    """A stand-in encoder: how often each letter occurs."""
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    return texts.select("text", F.array(*(count(c).cast("float") for c in "abcdefghijklmnopqrstuvwxyz")).alias("vector"))


def last_words(n):
    """A stand-in recogniser: the last word of each note is a DRUG."""
    word = F.substring_index("norm", " ", -1)
    return n.select("note_id", F.lit("DRUG").alias("entity_group"), F.lit(None).cast("string").alias("entity"), word.alias("word"), (F.length("norm") - F.length(word)).alias("start"), F.length("norm").alias("end"), F.lit(1.0).alias("score"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    syn = spark.createDataFrame([(0, "ibuvoltina", "Ibuvoltin", "active", ["voltinolo"], None)], "seq long, ingredient_it string, ingredient_en string, type string, synonyms_it array<string>, synonyms_en array<string>")
    drugs = spark.createDataFrame([("1", "ZORAMEL*20CPR", "Ibuvoltina"), ("2", "ZORAMEL*10CPR", "Ibuvoltina"), ("3", "DUALEXIN*1CPR", "Ibuvoltina"), ("4", "DUALEXIN*2CPR", "Altra sostanza")], "aic string, name string, composition string").withColumn("seq", F.col("aic").cast("long"))
    out = str(tmp_path_factory.mktemp("engine"))
    tables.write_kb(kb.build(raw.clean_synonyms(syn), raw.clean_drugs(drugs)), f"{out}/kb")
    return out


def test_engine_from_config(spark, folder):
    cfg = from_mapping({"semantic": {"enabled": True, "threshold": 0.8, "encoder": "test_engine:letters", "recogniser": "test_engine:last_words"}, "paths": {"knowledge_base": f"{folder}/kb", "index": f"{folder}/index"}})
    engine.build_index(spark, cfg)
    texts = spark.createDataFrame([(1, "reazione a voltinlo"), (2, "reazione a voltinolo"), (3, None)], "note_id long, text string")
    got = {r.note_id: r for r in engine.build(spark, cfg).standardize(texts).collect()}
    assert got[1].standardized_text == "reazione a voltinlo [Ibuvoltin]" and got[1].matches[0].method == "semantic_embedding" and got[1].num_semantic_resolved_matches == 1
    assert got[2].matches[0].method == "aho_corasick_exact" and got[3].matches == []
    off = engine.build(spark, replace(cfg, semantic=SemanticConfig()))
    assert {r.note_id: len(r.matches) for r in off.standardize(texts).collect()} == {1: 0, 2: 1, 3: 0}
    with pytest.raises(ValueError, match="module:function"):
        engine.build(spark, replace(cfg, semantic=SemanticConfig(enabled=True)))


def test_metadata_of_mentions(spark, folder):
    cfg = EngineConfig(ambiguous_brand_policy="list", paths=PathsConfig(f"{folder}/kb"))
    texts = spark.createDataFrame([(1, "Zoramel e poi DUALEXIN, Zoramel 20cpr")], "note_id long, text string")
    r = engine.build(spark, cfg).standardize(texts).first()
    assert [(m.target_type, m.metadata) for m in r.matches] == [("drug_brand", {"brand_name": "ZORAMEL", "brand_status": "single_active_signature"}), ("drug_product", {"drug_name": "ZORAMEL*20CPR", "drug_code": "1"})]
    assert r.ambiguous[0].metadata["policy"] == "list" and "active:altra_sostanza" in r.ambiguous[0].metadata["active_ingredient_signatures"]


def test_own_matchers(spark, folder):
    """Another exact matcher and two fallbacks; the second layer yields to the first."""
    base = tables.read_kb(spark, f"{folder}/kb")
    row = lambda s, e, raw: (1, raw, s, e, "active:ibuvoltina", "ingredient", raw, raw, "clinical", 1.0, 80, "own", False)
    of = lambda *found: spark.createDataFrame([row(*f) for f in found], CANDIDATES)
    texts = spark.createDataFrame([(1, "abcd efgh ijkl")], "note_id long, text string")
    got = notes.standardize(texts, base, matcher=lambda n: of((0, 4, "abcd")), fallbacks=[lambda n, d: of((0, 9, "abcd efgh")), lambda n, d: of((10, 14, "ijkl"))]).first()
    assert [(m.start, m.end) for m in got.matches] == [(0, 4), (10, 14)] and got.num_fallback_candidates == 2
    with pytest.raises(Exception, match="unknown target type other"):
        notes.standardize(texts, base, matcher=lambda n: of((0, 4, "abcd")).withColumn("target_type", F.lit("other"))).collect()


def test_find_terms(spark):
    similarity.register(spark)
    got = spark.sql("SELECT term, start, end FROM VALUES ('È (E 171) o disodio, sodio'), (NULL) AS t(x), LATERAL find_terms(x, array('sodio', 'E171', 'e', 'e'))").collect()
    assert sorted(tuple(r) for r in got) == [("E171", 3, 8), ("e", 0, 1), ("sodio", 21, 26)]


def test_last_of_repeated_ids_wins(spark, folder, tmp_path):
    base = tables.read_kb(spark, f"{folder}/kb")
    tables.write_kb(base, str(tmp_path / "kb"), "json")
    c = base.concepts.first()
    twice = [tuple({**c.asDict(), "canonical_it": x}.values()) for x in ("zz first", "mm", "aa last")]
    spark.createDataFrame(twice, base.concepts.schema).coalesce(1).write.mode("overwrite").json(str(tmp_path / "kb" / "concepts"))
    assert [r.canonical_it for r in tables.read_kb(spark, str(tmp_path / "kb"), "json").concepts.collect()] == ["aa last"]


def test_session(spark, folder):
    """Answers by line, as text with mentions and as JSON, to the line that ends it."""
    made = engine.build(spark, EngineConfig(paths=PathsConfig(f"{folder}/kb")))
    said = list(cli.answers(made, spark, ["  reazione a voltinolo\n", " \n", "niente\n", ":Quit\n", "voltinolo\n"], mentions=True))
    assert [x.split("\n")[0] for x in said] == ["reazione a voltinolo [Ibuvoltin]", "niente"]
    assert "1 matches, 0 ambiguous" in said[0] and said[0].split("\n")[2].startswith("  [11, 20) voltinolo: Ibuvoltin (active:ibuvoltina, ") and len(said[1].split("\n")) == 2
    whole = json.loads(next(cli.answers(made, spark, ["voltinolo"], as_json=True)).rpartition("\n")[0])
    assert whole["matches"][0]["target_id"] == "active:ibuvoltina" and whole["num_matches"] == 1


def test_unstaging_gives_freed_memory_back(spark):
    """Blocks freed below one that stays in use, too small to be mapped by themselves: of this process, and of the JVM (a deflater's)."""
    held = lambda pid: int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * resource.getpagesize() >> 20
    jvm = spark.sparkContext._gateway.proc.pid
    table = staging.staged(spark.range(3), "freed")
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    blocks = [libc.malloc(60_000) for _ in range(3000)]
    for block in blocks:
        ctypes.memset(block, 1, 60_000)
    deflaters = [spark._jvm.java.util.zip.Deflater() for _ in range(2500)]
    for block in blocks[:-1]:
        libc.free(block)
    for deflater in deflaters[:-1]:
        deflater.end()
    before = held(os.getpid()), held(jvm)
    staging.unstage(table)
    after = held(os.getpid()), held(jvm)
    libc.free(blocks[-1])
    deflaters[-1].end()
    assert after[0] < before[0] - 120 and after[1] < before[1] - 200, (before, after)
