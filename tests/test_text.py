"""Normalisation, offsets, names, policy."""

import random

import pytest
from pyspark.sql import functions as F

from termloom.config import EngineConfig, NormalizerConfig, from_mapping
from termloom.functions import policy
from termloom.functions import text as t

PAIRS = [
    ("Ècarlatina", "ecarlatina"), ("Ossido di calcite (E 529)", "ossido di calcite e529"), ("Ossido di calcite (e529)", "ossido di calcite e529"), ("G K & M #7", "g k m 7"),
    ("estere 4–butilico", "estere 4-butilico"), (None, ""), ("", ""), ("  \t ", ""), ("Straße ½ ™ l’acqua", "strasse 1 2 tm l'acqua"), ("e 500 mg", "e500 mg"), ("a b", "a b"), ("α-tocoferolo", "a-tocoferolo"),
]


def test_normalize_both_ways(spark):
    df = spark.createDataFrame([(a,) for a, _ in PAIRS], "x string").select("x", t.normalize(F.col("x")).alias("n"), t.normalize_with_mapping()("x").alias("m"))
    expected = dict(PAIRS)
    for r in df.collect():
        assert r.n == expected[r.x] == r.m.text
        assert len(r.m.map) == len(r.m.text)


def test_native_equals_mapped_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aE e1 7(5)&#-'.ÄÉñßœ–’\n\tBZ_+") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.normalize(F.col("x")).alias("n"))
    for r in df.collect():
        assert r.n == t.map_text(r.x)[0], r.x


@pytest.mark.parametrize("cfg", [NormalizerConfig(), NormalizerConfig(lowercase=False), NormalizerConfig(strip_accents=False), NormalizerConfig(lowercase=False, strip_accents=False)])
def test_native_equals_mapped_on_every_character(spark, cfg):
    """All characters that both Unicode versions know, each between others."""
    import unicodedata

    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(f"1{chr(c)}a {chr(c)}B",) for c in codes], "x string").repartition(8)
    known = df.where(~F.col("x").rlike("\\p{Cn}"))
    bad = known.select("x", t.normalize(F.col("x"), cfg).alias("n"), t.normalize_with_mapping(cfg)("x").alias("m")).where("n <> m.text")
    assert [(r.x, r.n, r.m.text) for r in bad.limit(5).collect()] == [] and known.count() > 100_000


def test_other_scripts_are_spelled(spark):
    cases = {"Парацетамол 5": "paratsetamol 5", "𝐀spirina": "aspirina", "щука": "shchuka", "שלום": "shlvm", "カナ": "kana", "한글": "hangeul", "中文": "u4e2du6587", "٣": "3", "ﬁbra ½ ²": "fibra 1 2 2", "µg": "mg", "É™": "etm"}
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", t.normalize(F.col("x")).alias("n"))
    assert {r.x: r.n for r in df.collect()} == cases and all(t.map_text(x)[0] == y for x, y in cases.items())


@pytest.mark.parametrize("text,part,original", [("Reazione a Voltinolo.", "voltinolo", "Voltinolo"), ("Calcite (E 529)", "e529", "E 529"), ("x G K & M #7 y", "g k m 7", "G K & M #7")])
def test_original_span(spark, text, part, original):
    n, m = t.map_text(text)
    start = n.index(part)
    span = spark.createDataFrame([(m,)], "m array<int>").select(t.original_span(F.col("m"), F.lit(start), F.lit(start + len(part))).alias("s")).first().s
    assert text[span.start : span.end] == original


def test_original_span_refuses_empty_spans(spark):
    with pytest.raises(Exception, match="empty or outside"):
        spark.createDataFrame([([0, 1],)], "m array<int>").select(t.original_span(F.col("m"), F.lit(1), F.lit(1)).alias("s")).collect()


def test_ids_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(t.normalize_for_id(F.lit("Ossido di calcite (E529)"))) == "ossido_di_calcite_e529"
    assert one(t.normalize_for_id(F.lit("--"))) == ""
    assert one(t.base_name(F.lit("ZORAMEL RP*40CPR RIV2MG"))) == "ZORAMEL RP"
    assert one(t.base_name(F.lit("DUALEXIN 250 MG GOCCE"))) == "DUALEXIN 250 MG GOCCE"
    assert one(t.base_name(F.lit(None).cast("string"))) == ""
    assert one(t.normalize(F.lit("ZORAMEL DU KLN*28CPR 20+5MG"))) == "zoramel du kln 28cpr 20+5mg"
    assert one(t.dictionary_key(F.lit(" (calcite  diidrata). "))) == "calcite_diidrata"


def test_options():
    assert t.map_text("É & #", NormalizerConfig(keep_ampersand=True, keep_hash=True))[0] == "e & #"
    cfg = from_mapping({"output_language": "it", "fuzzy": {"enabled": True, "strategies": ["symspell"]}, "unknown": 1})
    assert cfg.output_language == "it" and cfg.fuzzy.enabled and cfg.fuzzy.strategies == ("symspell",)
    with pytest.raises(ValueError):
        EngineConfig(note_output_policy="none")
    with pytest.raises(ValueError):
        from_mapping({"fuzzy": {"strategies": ["other"]}})


@pytest.mark.parametrize("raw,reason,safe,context", [
    ("QRVT", "short_acronym_alias", False, True), ("PEG 400", "short_acronym_alias", False, True), ("E 529", "clinical_code_alias", True, False), ("sale", "short_alias", False, True),
    ("(±)-2-[4-(isobutil)fenil]-propanoico", "technical_chemical_alias", False, False), ("voltinolo", "clinical_alias", True, False), ("D & C #9", "short_acronym_alias", False, True),
])
def test_policy(spark, raw, reason, safe, context):
    p = spark.range(1).select(policy.classify(F.lit(raw), t.normalize(F.lit(raw))).alias("p")).first().p
    assert (p.reason, p.safe, p.requires_context) == (reason, safe, context)


def test_running_offsets(spark):
    rng = random.Random(1)
    for n in (0, 1, 127, 128, 129, 1000):
        xs = [rng.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(xs,)], "x array<int>").select(t.running_offsets(F.col("x")).alias("o")).first().o
        assert got == [sum(xs[:i]) for i in range(n)]


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(t.edit_score(F.lit(1), F.lit("abc def"), F.lit("abcdeg"))) == pytest.approx(1 - 1 / 6)
    assert one(t.pseudo_distance(F.lit(0.5), F.lit("abcde"), F.lit("abcde"))) == 2
    assert sorted(one(t.char_ngrams(F.lit("ab-cd")))) == ["abc", "bcd"] and one(t.char_ngrams(F.lit("ab"))) == ["ab"] and one(t.char_ngrams(F.lit("-"))) == []
    tokens = lambda x: t.informative_tokens(F.lit(x), ["di"])
    assert one(t.dice(tokens("olio di ricino"), tokens("ricino olio"))) == 1.0 and one(t.dice(tokens("di"), tokens("ricino"))) == 1.0
