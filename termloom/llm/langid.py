"""Language identification by Bayesian evidence fusion.

For each page: log prior of its host + log likelihood of its text + log likelihood of the language its markup
declares + log likelihood of its address suffix. The text model is a multinomial over hashed words and
n-grams, counted over all labelled documents. The other tables are grouped sums of the pages' text-only
posteriors: by declared language, by suffix, and by host; a host's prior is smoothed towards its domain's, that
towards its suffix's, that towards all pages', each time without the page's own vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import slices, staged
from termloom.llm.quality import grams

BUCKETS = 1 << 15
#: Pseudo-counts: of a bucket in the text model, of a parent's prior, of a language in an evidence table.
ALPHA, PARENT, EVIDENCE = 0.5, 5.0, 1.0
#: A text counts as at most this many independent n-grams: neighbouring ones overlap.
INDEPENDENT = 40.0


def visible_text(html: Column) -> Column:
    """The text of a page: comments, scripts, styles and tags become spaces; null is empty.

    A comment, script or style that isn't closed reaches to the page's end; a tag holds no other "<", so one that isn't closed stays
    as text. Each pattern reads a character a bounded number of times, however broken the page.
    """
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*+>|\z)", " ")
    t = F.regexp_replace(t, r"<[^<>]*+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def declared_language(html: Column) -> Column:
    """The primary subtag of <html lang=...>, or else of <meta http-equiv="content-language" content=...>, lower-cased; empty if none."""
    h = F.coalesce(html, F.lit(""))
    of_html = F.regexp_extract(h, r"(?i)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})\b", 1)
    of_meta = F.regexp_extract(h, r"(?i)<meta\b(?=[^<>]*?\bhttp-equiv\s*+=\s*+[\"']?content-language\b)[^<>]*?\bcontent\s*+=\s*+[\"']?([A-Za-z]{2,3})\b", 1)
    return F.lower(F.when(of_html != "", of_html).otherwise(of_meta))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; the last three where the last two are a country's registry for one kind of holder, as co.uk."""
    # Second-level names that registries of countries hand out below.
    shared = host.rlike(r"\.(?:ac|co|com|edu|gob|gov|net|or|org)\.[a-z]{2}$")
    return F.when(shared, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of docs(text, lang), and log shares of each bucket by language, counted over all of docs.

    The counts are summed within each task first; languages times buckets of them reach the driver.
    """
    rows = docs.where("lang IS NOT NULL").select("text", "lang")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = {x: i for i, x in enumerate(langs)}, np.zeros(len(langs) * BUCKETS, np.int64)
        for batch in batches:
            for start, texts in slices(batch.column(0), 1 << 18):
                doc, bucket, _ = grams(texts)
                of = np.array([index[x] for x in batch.column(1).slice(start, len(texts)).to_pylist()], np.int64)
                total += np.bincount(of[doc] * BUCKETS + bucket % BUCKETS, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    got = rows.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(langs) * BUCKETS)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    counts = counts.reshape(len(langs), BUCKETS) + ALPHA
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def text_likelihoods(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """pages(page_id, host, suffix, declared, text) with text replaced by like: log likelihoods by language, tempered."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c != "text"]
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in kept) + ", like array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            names = batch.schema.names
            for start, texts in slices(batch.column(names.index("text")), 1 << 18):
                doc, bucket, n = grams(texts)
                count = np.maximum(np.bincount(doc, minlength=n), 1)
                like = np.stack([np.bincount(doc, weights=row[bucket % BUCKETS], minlength=n) for row in table], 1)
                like = like * (np.minimum(count, INDEPENDENT) / count)[:, None]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in kept), pa.array(list(like), pa.list_(pa.float64()))], [*kept, "like"])

    return pages.select(*kept, "text").mapInArrow(run, schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared of every row of pages(page_id, url, html), by docs(text, lang).

    A null url has an empty host and suffix, a null html no text and nothing declared: what evidence is left, at
    last the prior of all pages, decides. Ties go to the first language by name. Rows stay one to one, whether
    page_ids repeat or are null. Without any labelled document lang, posterior and text_lang are null.
    """
    langs, model = text_model(docs)
    host = host_of(F.col("url"))
    read = pages.select("page_id", host.alias("host"), declared_language(F.col("html")).alias("declared"), visible_text(F.col("html")).alias("text"))
    if not langs:
        return read.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared")
    read = read.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", domain_of(F.col("host")))
    k = len(langs)
    names = F.array(*map(F.lit, langs))
    pick = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    p = text_likelihoods(read.select("page_id", "host", "domain", "suffix", "declared", "text"), model)
    p = p.withColumn("own", _softmax(F.col("like")))
    p = staged(p.withColumn("text_lang", pick(F.col("own"))), "pages")

    def votes(*by: str, name: str) -> DataFrame:
        sums = p.groupBy(*by).agg(*(F.sum(F.get("own", F.lit(i))).alias(f"v{i}") for i in range(k)))
        return sums.select(*by, F.array(*(f"v{i}" for i in range(k))).alias(name))

    every = votes(name="v_all")
    j = p.join(F.broadcast(every), how="cross")  # one row
    for by in ("suffix", "domain", "host", "declared"):
        # a few numbers for each value; Spark sees the sizes at run time and splits a hot value's rows
        j = j.join(votes(by, name=f"v_{by}"), by)
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    minus_own = lambda c: F.zip_with(F.col(c), F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    share = lambda c, parent, weight: F.zip_with(c, parent, lambda a, q: (a + weight * q) / (size(c) + weight))
    flat = F.array(*[F.lit(1.0 / k)] * k)
    j = j.withColumn("r_all", share(minus_own("v_all"), flat, EVIDENCE))
    for by, parent in (("suffix", "all"), ("domain", "suffix"), ("host", "domain")):
        j = j.withColumn(f"m_{by}", minus_own(f"v_{by}")).withColumn(f"r_{by}", share(F.col(f"m_{by}"), F.col(f"r_{parent}"), PARENT))
    # P(declared | lang) and P(suffix | lang), up to a factor that is the same for all languages
    evidence = lambda by: F.zip_with(F.col(f"v_{by}"), F.col("v_all"), lambda a, t: F.log((a + EVIDENCE) / (t + EVIDENCE * k)))
    said = F.when(F.col("declared") == "", F.transform(F.col("like"), lambda x: F.lit(0.0))).otherwise(evidence("declared"))
    parts = F.arrays_zip(F.col("like").alias("a"), F.transform("r_host", lambda x: F.log(x)).alias("b"), said.alias("c"), evidence("suffix").alias("d"))
    j = j.withColumn("logs", F.transform(parts, lambda x: x["a"] + x["b"] + x["c"] + x["d"])).withColumn("post", _softmax(F.col("logs")))
    return j.select("page_id", pick(F.col("post")).alias("lang"), F.array_max("post").alias("posterior"), "text_lang", "declared")
