"""Jobs for spark-submit: build-kb, build-index, standardize, inspect; and session, which answers notes line by line."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Iterable, Iterator
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom import engine
from termloom.config import EngineConfig, PathsConfig, load_config
from termloom.operators import inspection, kb
from termloom.sources import raw, tables


# Lines that end a session.
LEAVE = (":q", ":quit", ":exit")


def answers(made: engine.Engine, spark: SparkSession, lines: Iterable[str], as_json: bool = False, mentions: bool = False) -> Iterator[str]:
    """What is said to each line, a note of its own, until one of LEAVE in any case: the standardised note, its counts, the seconds
    taken and, if asked, its mentions; or the whole result as JSON. Blank lines get no answer."""
    for text in map(str.strip, lines):
        if text.lower() in LEAVE:
            return
        if not text:
            continue
        began = time.perf_counter()
        row = made.standardize(spark.createDataFrame([(0, text)], "note_id long, text string")).first().asDict(recursive=True)
        took = f"{time.perf_counter() - began:.2f} s"
        if as_json:
            yield json.dumps(row, ensure_ascii=False, indent=2) + "\n" + took
            continue
        said = [row["standardized_text"], f"{len(row['matches'])} matches, {len(row['ambiguous'])} ambiguous, {took}"]
        if mentions:
            said += [f"  [{m['start']}, {m['end']}) {m['original_surface']}: {m['annotation'] or '-'} ({m['target_id']}, {m['method']}, {m['status']})" for m in row["matches"] + row["ambiguous"]]
        yield "\n".join(said)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="termloom")
    p.add_argument("--config", help="YAML file of engine options")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("build-kb")
    b.add_argument("synonyms")
    b.add_argument("drugs")
    b.add_argument("out")
    s = sub.add_parser("standardize")
    s.add_argument("kb")
    s.add_argument("notes", help="Parquet with note_id and text, or a text file of one note a line")
    s.add_argument("out", nargs="?", help="folder to write to; without it the first results are shown as JSON")
    s.add_argument("--index", default="", help="folder of the semantic index, for semantic.enabled")
    s.add_argument("--show", type=int, default=20, help="results shown where no folder is given")
    t = sub.add_parser("session", help="answer notes read from standard input, one a line")
    t.add_argument("kb")
    t.add_argument("--index", default="", help="folder of the semantic index, for semantic.enabled")
    t.add_argument("--json", action="store_true", help="whole results as JSON")
    t.add_argument("--mentions", action="store_true", help="list each note's mentions")
    x = sub.add_parser("build-index", help="encode the knowledge base's aliases for the semantic layer")
    x.add_argument("kb")
    x.add_argument("index")
    i = sub.add_parser("inspect")
    i.add_argument("kb")
    i.add_argument("--search")
    i.add_argument("--top", type=int, default=20)
    a = p.parse_args(argv)
    cfg = load_config(a.config) if a.config else EngineConfig()
    spark, began = SparkSession.builder.getOrCreate(), time.time()
    if a.job == "build-kb":
        built = kb.build(raw.read_synonyms(spark, a.synonyms), raw.read_drugs(spark, a.drugs), cfg)
        tables.write_kb(built, a.out)
        spark.read.parquet(f"{a.out}/report").show(truncate=False)
    elif a.job == "build-index":
        engine.build_index(spark, replace(cfg, paths=PathsConfig(a.kb, a.index)))
    elif a.job == "standardize":
        rows = spark.read.text(a.notes).select(F.monotonically_increasing_id().alias("note_id"), F.col("value").alias("text")) if a.notes.endswith(".txt") else spark.read.parquet(a.notes)
        out = engine.build(spark, replace(cfg, paths=PathsConfig(a.kb, a.index))).standardize(rows.select("note_id", "text"))
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
        else:
            for line in out.limit(a.show).toJSON().collect():
                print(line)
    elif a.job == "session":
        for said in answers(engine.build(spark, replace(cfg, paths=PathsConfig(a.kb, a.index))), spark, sys.stdin, a.json, a.mentions):
            print(said, flush=True)
    else:
        found = tables.read_kb(spark, a.kb)
        views = [inspection.search(found, a.search, a.top)] if a.search else [found.report, inspection.concept_summary(found), inspection.alias_summary(found), inspection.longest_technical(found, a.top), inspection.brand_summary(found), inspection.largest_brands(found, a.top), inspection.created_issues(found)]
        for df in views:
            df.show(a.top, truncate=False)
    print(f"{time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
