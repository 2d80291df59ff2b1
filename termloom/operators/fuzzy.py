"""The fuzzy layer: candidate spans in what exact matching left, two similarity joins, acceptance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.config import AcceptanceConfig, FuzzyConfig
from termloom.functions import text as t
from termloom.functions.scan import each_note
from termloom.functions.similarity import osa_distance, token_set_ratio, token_sort_ratio
from termloom.operators.overlap import free, with_spans
from termloom.sources.staging import staged

# Function words and filler of clinical notes.
STOPWORDS = (
    "a", "ad", "al", "allo", "alla", "ai", "agli", "alle", "con", "da", "dal", "dalla", "del", "dello", "della", "dei", "degli", "delle", "di", "e",
    "ed", "il", "lo", "la", "i", "gli", "le", "in", "nel", "nella", "nei", "negli", "nelle", "o", "od", "per", "su", "sul", "sulla", "tra", "fra",
    "un", "uno", "una", "paziente", "pz", "allergia", "allergico", "allergica", "intolleranza", "intollerante", "reazione", "rash", "dopo",
    "assunzione", "terapia", "farmaco", "farmaci", "compresse", "compressa", "capsule", "capsula", "mg", "ml", "g",
)
TOKEN = "[a-z0-9]+(?:[+\\-'][a-z0-9]+)*"
ALIAS = ["target_id", "target_type", "alias_raw", "alias_normalized", "alias_category", "priority", "requires_context"]


def is_stopword(x: Column) -> Column:
    return x.isin(*STOPWORDS)


def eligible(aliases: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Aliases that the fuzzy and semantic layers may suggest."""
    return aliases.where(F.col("target_type").isin(*cfg.target_types) & (F.col("alias_category") == "clinical") & F.col("safe_for_exact_match") & (F.col("policy_reason") == "clinical_alias") & (F.col("alias_normalized") != ""))


def tokens(notes: DataFrame, segments: DataFrame) -> DataFrame:
    """(note_id, segment, idx, token, start, end) of each segment(note_id, start, end) of notes(note_id, norm), tokenised by itself."""
    def make():
        found = re.compile(TOKEN)

        def emit(norm, spans, segments, places, words, starts, ends):
            for span in spans:
                a, b = span["start"], span["end"]
                for i, m in enumerate(found.finditer(norm[a:b])):
                    segments.append(a)
                    places.append(i)
                    words.append(m[0])
                    starts.append(a + m.start())
                    ends.append(a + m.end())

        return emit

    columns = {"segment": "int", "idx": "int", "token": "string", "start": "int", "end": "int"}
    return each_note(with_spans(notes, segments).where("spans IS NOT NULL AND norm IS NOT NULL"), ["norm", "spans"], columns, make)


def candidates(notes: DataFrame, protected: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """(note_id, start, end, text, token_count): runs of up to max_tokens tokens of a gap, without stopwords at their ends.

    These are all runs from a token that is no stopword to another, or itself. At least one of a run's tokens is no stopword, no number and
    long enough, so no run is of digits alone.
    """
    most, least, least_token, stop = cfg.max_tokens, cfg.min_candidate_chars, cfg.min_token_chars, frozenset(STOPWORDS)

    def make():
        found, number = re.compile(TOKEN), re.compile("[0-9]+")

        def emit(norm, spans, starts, ends, texts, counts):
            norm = norm or ""
            for a, b in free(len(norm), spans):
                solid = []
                for i, m in enumerate(found.finditer(norm[a:b])):
                    word = m[0]
                    if word not in stop:
                        solid.append((i, a + m.start(), a + m.end(), len(word) >= least_token and not number.fullmatch(word)))
                for k, (i, start, _, _) in enumerate(solid):
                    telling = False
                    for j, _, end, tells in solid[k : k + most]:
                        if j - i >= most:
                            break
                        telling = telling or tells
                        if telling:
                            text = norm[start:end]
                            if len(text) - text.count(" ") >= least:
                                starts.append(start)
                                ends.append(end)
                                texts.append(text)
                                counts.append(j - i + 1)

        return emit

    return each_note(with_spans(notes, protected), ["norm", "spans"], {"start": "int", "end": "int", "text": "string", "token_count": "int"}, make)


def edit_dictionary(aliases: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """(key, weight, n_aliases) of the eligible aliases by dictionary key."""
    return eligible(aliases, cfg).groupBy(t.dictionary_key(F.col("alias_normalized")).alias("key")).agg(F.greatest(F.max("priority"), F.lit(1)).alias("weight"), F.count(F.lit(1)).alias("n_aliases")).where("key <> ''")


def _deletes(key: Column, distance: int, prefix: int) -> Column:
    """The key's prefix with up to `distance` characters left out, itself included."""
    out = F.array(F.substring(key, F.lit(1), F.lit(prefix)))
    for _ in range(distance):
        shorter = F.flatten(F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def edit_join(texts: DataFrame, keys: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """(text, key, distance) of all texts(text) and keys(key) within max_edit_distance.

    Both sides are joined on their length and what their prefixes leave after deletions; keys, the smaller side, take
    every length that is near theirs. Texts of lengths that no key is near to, most of them, go first. Only distinct
    texts are compared.
    """
    d = cfg.max_edit_distance
    right = keys.select("key").distinct().withColumn("size", F.explode(F.sequence(F.greatest(F.length("key") - d, F.lit(0)), F.length("key") + d)))
    left = texts.select("text").distinct().withColumn("tkey", t.dictionary_key(F.col("text"))).withColumn("size", F.length("tkey"))
    left = left.join(right.select("size").distinct(), "size", "left_semi").withColumn("block", F.explode(_deletes(F.col("tkey"), d, cfg.prefix_length)))
    right = right.withColumn("block", F.explode(_deletes(F.col("key"), d, cfg.prefix_length)))
    near = left.join(right, ["size", "block"]).select("text", "tkey", "key").distinct()
    # a swap of neighbours costs levenshtein two, so twice the distance bounds it: pairs beyond never reach Python
    near = near.where(F.levenshtein("tkey", "key", 2 * d) >= 0)
    return near.withColumn("distance", osa_distance("tkey", "key")).where(F.col("distance") <= d).select("text", "key", "distance")


def edit_suggestions(texts: DataFrame, aliases: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Scored suggestions of the edit layer: text, alias columns, distance, score."""
    found = eligible(aliases, cfg).select(*ALIAS, t.dictionary_key(F.col("alias_normalized")).alias("key")).where("key <> ''")
    return edit_join(texts, found.select("key"), cfg).join(found, "key").withColumn("score", t.edit_score(F.col("distance"), F.col("text"), F.col("alias_normalized"))).drop("key")


def trigram_block(texts: DataFrame, aliases: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """(text, alias columns, shared, overlap): for each distinct text the max_blocked aliases that share most n-grams.

    max_blocked is part of what is matched (a limit of the layer, not of the work); ties go by alias and target.
    """
    n = cfg.gram_size
    left = texts.select("text").distinct().withColumn("tg", t.char_ngrams(F.col("text"), n))
    right = eligible(aliases, cfg).select(*ALIAS).withColumn("ag", t.char_ngrams(F.col("alias_normalized"), n))
    keys = ["target_id", "alias_raw", "alias_normalized"]
    shared = left.select("text", F.size("tg").alias("tn"), F.explode("tg").alias("gram")).join(right.select(*ALIAS, F.size("ag").alias("an"), F.explode("ag").alias("gram")), "gram")
    counted = shared.groupBy("text", *keys).agg(F.count(F.lit(1)).alias("shared"), F.first("tn").alias("tn"), F.first("an").alias("an"), *(F.first(c).alias(c) for c in ALIAS if c not in keys))
    overlap = F.col("shared") / F.least("tn", "an")
    blocked = counted.withColumn("overlap", overlap).where((F.col("shared") >= cfg.min_shared_grams) & (F.col("overlap") >= cfg.min_gram_overlap))
    w = Window.partitionBy("text").orderBy(F.desc("shared"), F.desc("overlap"), F.desc("priority"), "alias_normalized", "target_id", "alias_raw")
    return blocked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cfg.max_blocked).select("text", *ALIAS, "shared", "overlap")


def ratio_suggestions(texts: DataFrame, aliases: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Scored suggestions of the ratio layer. The Dice gate, a plain predicate, goes before the ratios.

    A text can pass the gate only with an alias that shares an informative token with it, or where either has none. So
    only such texts are blocked by n-grams; the others could add nothing.
    """
    own = lambda c: t.informative_tokens(F.col(c), STOPWORDS)
    known = eligible(aliases, cfg).select(own("alias_normalized").alias("known")).distinct()
    if known.where(F.size("known") == 0).isEmpty():
        split = texts.select("text").distinct().withColumn("own", own("text"))
        sharing = split.select("text", F.explode("own").alias("token")).join(known.select(F.explode("known").alias("token")).distinct(), "token", "left_semi")
        texts = sharing.select("text").unionByName(split.where(F.size("own") == 0).select("text")).distinct()
    blocked = trigram_block(texts, aliases, cfg)
    gate = t.dice(t.informative_tokens(F.col("text"), STOPWORDS), t.informative_tokens(F.col("alias_normalized"), STOPWORDS))
    kept = blocked.withColumn("dice", gate).where(F.col("dice") >= cfg.min_token_dice)
    kept = kept.withColumn("sort_ratio", token_sort_ratio("text", "alias_normalized")).withColumn("set_ratio", token_set_ratio("text", "alias_normalized"))
    kept = kept.withColumn("score", F.greatest("sort_ratio", "set_ratio") * F.col("dice"))
    return kept.withColumn("distance", t.pseudo_distance(F.col("score"), F.col("text"), F.col("alias_normalized")))


def threshold(text: Column, cfg: AcceptanceConfig) -> Column:
    n = t.compact_length(text)
    return F.when(n <= cfg.short, cfg.thresholds[0]).when(n <= cfg.medium, cfg.thresholds[1]).otherwise(cfg.thresholds[2])


def accept(suggestions: DataFrame, least: Column, margin: float, keep: int, reasons: tuple[str, str], key: str = "text", ties: tuple = ("distance",)) -> DataFrame:
    """One decision for each key: the best suggestion, whether it is accepted, and why (not).

    suggestions(key, score, priority, target_id, alias_normalized, ...): ranked by score, then `ties` ascending, priority
    descending, alias and target. Rejected if below `least`, or if another target among the first `keep` comes within
    margin. Keys without suggestions have no row; their reason is that there was none.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), *ties, F.desc("priority"), "alias_normalized", "target_id")
    ranked = suggestions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    best = F.first("target_id").over(Window.partitionBy(key).orderBy("rn"))
    ranked = ranked.withColumn("best_target", best)
    rival = F.max(F.when(F.col("target_id") != F.col("best_target"), F.col("score"))).over(Window.partitionBy(key))
    top = ranked.withColumn("rival", rival).where("rn = 1").drop("rn", "best_target")
    below = F.col("score") < least
    close = F.coalesce(F.col("score") - F.col("rival") < margin, F.lit(False))
    return top.withColumn("reason", F.when(below, reasons[0]).when(close, reasons[1]).otherwise("accepted")).withColumn("accepted", F.col("reason") == "accepted")


FUZZY_REASONS = ("below_length_dependent_threshold", "ambiguous_fuzzy_suggestion")


def decide(suggestions: DataFrame, cfg: AcceptanceConfig) -> DataFrame:
    return accept(suggestions, threshold(F.col("text"), cfg), cfg.margin, cfg.keep, FUZZY_REASONS)


def as_matches(spans: DataFrame, decisions: DataFrame, method: str) -> DataFrame:
    """Accepted decisions on the spans they were made for, as candidates."""
    kept = decisions.where("accepted").select("text", *ALIAS, "score")
    return spans.join(kept, "text").select(
        "note_id", F.col("text").alias("surface"), "start", "end", "target_id", "target_type", "alias_raw", "alias_normalized", "alias_category",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("confidence"), "priority", F.lit(method).alias("method"), "requires_context",
    )


def layer(notes: DataFrame, protected: DataFrame, aliases: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """All strategies' matches on the same gaps, united. Texts are scored once each."""
    # both strategies read the spans, twice each
    spans = staged(candidates(notes, protected, cfg), "spans")
    out = None
    for name in ("symspell", "ngram_rapidfuzz"):
        if name in cfg.strategies:
            if name == "symspell":
                found = as_matches(spans, decide(edit_suggestions(spans, aliases, cfg), cfg.edit_acceptance), "symspell_fuzzy")
            else:
                found = as_matches(spans, decide(ratio_suggestions(spans, aliases, cfg), cfg.ratio_acceptance), "ngram_rapidfuzz")
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no fuzzy strategy is asked for")
    return out
