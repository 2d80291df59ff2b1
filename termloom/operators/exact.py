"""Exact dictionary matching as an equi-join on the first word of an alias.

A match starts and ends at a token boundary: the text's ends, or any character outside [a-z0-9_-]. So an alias
begins at the start of a run of such characters (or, if it begins with other characters, right before one),
and its first run is a whole run of the text. Runs are joined with aliases by that run; for the few that meet, the
alias is compared with the text at that place. An alias without any such character begins at one of the characters between runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.scan import each_note
from termloom.functions.text import runs_with_offsets

HEAD = "[a-z0-9_-]+"
RUNS = "[a-z0-9_-]+|[^a-z0-9_-]+"
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_-")


def indexed_aliases(aliases: DataFrame, include_unsafe: bool = False) -> DataFrame:
    """Aliases that may match, with the leading other characters (lead), first run (head; the first character where there is no run), and
    number of runs."""
    kept = aliases.where((F.col("safe_for_exact_match") | F.lit(include_unsafe)) & (F.col("alias_normalized") != ""))
    lead = F.regexp_extract("alias_normalized", "^[^a-z0-9_-]*", 0)
    core = F.substring(F.col("alias_normalized"), F.length(lead) + 1, F.length("alias_normalized"))
    return kept.select(
        "alias_raw", "alias_normalized", "target_id", "target_type", "alias_category", "priority", "requires_context", lead.alias("lead"), core.alias("core"),
        F.regexp_extract(core, "^[a-z0-9_-]+", 0).alias("head"), F.size(F.regexp_extract_all(core, F.lit(RUNS), F.lit(0))).alias("n_runs"),
    ).withColumn("lead", F.when(F.col("head") == "", "").otherwise(F.col("lead"))).withColumn("bare", F.col("head") == "").withColumn("head", F.when(F.col("head") == "", F.substring("alias_normalized", 1, 1)).otherwise(F.col("head")))


#: Notes that are searched at once.
PIECE = 64
#: Aliases up to which the index is broadcast (some 200 bytes each); beyond, runs are shuffled with what follows them.
BROADCAST = 500_000


def word_starts(notes: DataFrame, n_runs: int) -> DataFrame:
    """notes(note_id, norm) to one row a run of word characters: head, start, tail (n_runs + 1 runs from there), gap (what stands before)."""
    def make():
        def emit(norm, heads, starts, tails, gaps):
            runs = re.findall(RUNS, norm or "")
            at = 0
            for i, run in enumerate(runs):
                if run[0] in WORD:
                    heads.append(run)
                    starts.append(at)
                    tails.append("".join(runs[i : i + n_runs + 1]))
                    gaps.append(runs[i - 1] if i else "")
                at += len(run)

        return emit

    return each_note(notes, ["norm"], {"head": "string", "start": "int", "tail": "string", "gap": "string"}, make)


def finder(names: list[str]):
    """emit(norm, starts, names) of all places of the names in a text.

    A name's first run must be a whole run of the text. The names with that run are looked up by what the text has there in each of their
    lengths, so a place costs as many lookups as they have lengths, however many they are.
    """
    heads: dict[str, dict[int, dict[str, list[str]]]] = {}
    bare: dict[str, list[str]] = {}
    for name in names:
        if first := re.search(HEAD, name):
            core = name[first.start() :]
            heads.setdefault(first[0], {}).setdefault(len(core), {}).setdefault(core, []).append(name[: first.start()])
        else:
            bare.setdefault(name[0], []).append(name)
    words = re.compile(HEAD)
    signs = re.compile("[" + re.escape("".join(bare)) + "]") if bare else None
    lengths = {head: list(by.items()) for head, by in heads.items()}

    def emit(norm, starts, found):
        norm = norm or ""
        size = len(norm)
        for word in words.finditer(norm):
            known = lengths.get(word[0])
            if known is None:
                continue
            at = word.start()
            for n, cores in known:
                end = at + n
                core = norm[at:end]
                leads = cores.get(core)
                if leads is None or (end < size and norm[end] in WORD):
                    continue
                for lead in leads:
                    start = at - len(lead)
                    # right before the word stands no word character, so a lead of none is open
                    if not lead or (start >= 0 and norm.startswith(lead, start) and (not start or norm[start - 1] not in WORD)):
                        starts.append(start)
                        found.append(lead + core)
        for sign in signs.finditer(norm) if signs else ():
            start = sign.start()
            for name in bare[sign[0]]:
                end = start + len(name)
                if norm.startswith(name, start) and (not start or norm[start - 1] not in WORD) and (end >= size or norm[end] not in WORD):
                    starts.append(start)
                    found.append(name)

    return emit


def match(notes: DataFrame, aliases: DataFrame, include_unsafe: bool = False) -> DataFrame:
    """notes(note_id, norm) and alias rows to candidates (schemas.CANDIDATES), overlapping ones included.

    Up to BROADCAST aliases are looked up where the text is, and their rows come to the places found; of more, runs are dealt out by their
    first word with as many runs behind them as the longest alias has. Null texts have no match.
    """
    index = indexed_aliases(aliases, include_unsafe)
    about = index.agg(F.count(F.lit(1)).alias("n"), F.max("n_runs").alias("most"), F.max("bare").alias("bare")).first()
    name, size = F.col("alias_normalized"), F.length("alias_normalized")
    if about["n"] <= BROADCAST:
        names = index.select("alias_normalized").distinct().toArrow().column(0).to_pylist()
        found = each_note(notes, ["norm"], {"start": "int", "alias_normalized": "string"}, lambda: finder(names), PIECE)
        return _candidates(found.join(F.broadcast(index), "alias_normalized"), F.col("start"))
    found = word_starts(notes, about["most"]).join(index.where(~F.col("bare")), "head")
    after = F.substring(F.col("tail"), F.length("core") + 1, F.lit(1))
    closed = F.startswith("tail", F.col("core")) & ((after == "") | ~after.rlike("[a-z0-9_-]"))
    # nothing or a boundary character before: the lead may fill the gap only at the text's start
    opened = F.endswith("gap", F.col("lead")) & ((F.length("lead") == 0) | (F.length("gap") > F.length("lead")) | (F.col("start") == F.length("lead")))
    out = _candidates(found.where(closed & opened), F.col("start") - F.length("lead"))
    if not about["bare"]:
        return out
    # aliases of signs alone: each character between runs with the rest of its gap
    signs = sign_starts(notes).join(index.where("bare"), "head")
    whole = F.startswith("tail", name) & ((F.length("tail") > size) | F.col("ends"))
    return out.unionByName(_candidates(signs.where(whole & F.col("opens")), F.col("start")))


def sign_starts(notes: DataFrame) -> DataFrame:
    """notes(note_id, norm) to one row a character between runs of word characters: head, start, tail (the rest of the gap), ends (the gap ends the
    text), opens (no word character stands before)."""
    runs = F.filter(runs_with_offsets(F.col("norm"), RUNS), lambda r: ~r["run"].rlike("^[a-z0-9_-]"))
    each = notes.select("note_id", F.length("norm").alias("size"), F.explode(runs).alias("r")).select("note_id", "size", "r.run", F.col("r.start").alias("gap_start"), F.explode(F.sequence(F.lit(1), F.length("r.run"))).alias("i"))
    start = F.col("gap_start") + F.col("i") - 1
    tail = F.substring(F.col("run"), F.col("i"), F.length("run"))
    return each.select("note_id", F.substring(F.col("run"), F.col("i"), F.lit(1)).alias("head"), start.alias("start"), tail.alias("tail"), (F.col("gap_start") + F.length("run") == F.col("size")).alias("ends"), ((F.col("i") > 1) | (F.col("gap_start") == 0)).alias("opens"))


def _candidates(found: DataFrame, start: Column) -> DataFrame:
    return found.select(
        "note_id", F.col("alias_normalized").alias("surface"), start.cast("int").alias("start"), (start + F.length("alias_normalized")).cast("int").alias("end"), "target_id", "target_type",
        "alias_raw", "alias_normalized", "alias_category", F.lit(1.0).alias("confidence"), "priority", F.lit("aho_corasick_exact").alias("method"), "requires_context",
    )
