"""Quality rules with risk-controlled cutoffs, in DataFrame operations alone.

Each rule is a ratio in which larger is worse. On labelled holdout rows of quality 1 (the null
hypothesis of a cutoff: it rejects more than alpha of them), an exact binomial test is made for each
cutoff from the mildest on; a stratum's cutoff is the strictest one up to which every test passes (fixed
sequence), at level delta over the number of strata and rules (Bonferroni). So with probability
1 - delta no stratum loses more than alpha of its good documents to a rule.

Equal texts are one trial, since the bound is for independent ones; near copies count each. Even a cutoff that rejects none of n good texts
passes only if (1 - alpha / rules) ** n <= delta / (rules * strata): with the defaults 777 of a stratum are needed. Fewer certify
nothing, and then only the base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import SPACES, WORD_GAP, held_out, let, staged

#: Rule name to (numerator, denominator) among the feature columns.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Strata by number of words: the lower bounds of all but the first.
STRATA = (200, 800)
#: Cutoffs tried lie on this grid of [0, 1].
GRID = 100
_LOW = 0xFFFFFF


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array words.

    Windows are sorted as longs: 40 bits of hash over 24 bits of position. If a hash meets two different
    windows, or the positions don't fit, the windows themselves are sorted instead.
    """

    def at(i: Column, k: int = 0) -> Column:
        return F.get(words, i + k)

    def covered(places: Column) -> Column:
        """Size of the union of [p, p + 3) over the sorted places."""
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).cast("int").alias("n"), (p + 3).cast("int").alias("end"))
        return F.aggregate(places, F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end")), step, lambda acc: acc["n"])

    spots = F.sequence(F.lit(0), F.size(words) - 3)

    def from_hashes(packed: Column) -> Column:
        same = lambda a, b: F.coalesce(F.shiftright(a, 24) == F.shiftright(b, 24), F.lit(False))
        kept = F.filter(packed, lambda x, i: same(x, F.get(packed, i + 1)) | same(x, F.when(i > 0, F.get(packed, i - 1))))

        def checked(k: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")
            window = lambda x: F.array(at(place(x)), at(place(x), 1), at(place(x), 2))
            differs = F.exists(F.transform(k, lambda x, i: F.struct(x.alias("x"), F.get(k, i + 1).alias("y"))), lambda s: same(s["x"], s["y"]) & (window(s["x"]) != window(s["y"])))
            return F.when(F.size(k) == 0, 0).when(differs, exact()).otherwise(covered(F.array_sort(F.transform(k, place))))

        return let(kept, checked)

    def exact() -> Column:
        rows = F.array_sort(F.transform(spots, lambda i: F.struct(F.array(at(i), at(i, 1), at(i, 2)).alias("w"), i.alias("i"))))
        return let(rows, lambda r: covered(F.array_sort(F.transform(F.filter(r, lambda x, i: F.coalesce(x["w"] == F.get(r, i + 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.when(i > 0, F.get(r, i - 1))["w"], F.lit(False))), lambda x: x["i"]))))

    packed = F.sort_array(F.transform(spots, lambda i: F.xxhash64(at(i), at(i, 1), at(i, 2)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
    return F.when(F.size(words) < 4, 0).when(F.size(words) > _LOW, exact()).otherwise(let(packed, from_hashes))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed and text_key (a hash) of every whole text.

    A null or empty text has zeros and fails the base rules. Rows stay one to one; other columns aren't read.
    """
    def of(t: Column) -> Column:
        chars = F.length(t)
        words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))
        # a word before and after, taken off again, spares a search for empty strings at the ends
        split = F.split(F.concat(F.lit("x "), t, F.lit(" x")), WORD_GAP, -1)
        inner = let(split, lambda w: F.slice(w, 2, F.size(w) - 2))
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
        dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
        return F.struct(
            (chars - (F.length(F.translate(t, "#*$%&|<>", "")))).cast("long").alias("n_symbols"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"), let(inner, words).alias("w"), dup.alias("l"), F.xxhash64(t).alias("text_key"),
        )

    f = docs.select(F.col(id_col).alias("doc_id"), let(F.coalesce(F.col(text_col), F.lit("")), of).alias("f"))
    f = f.select("doc_id", "f.w.n_words", "f.word_chars", "f.n_symbols", "f.l.n_lines", "f.l.n_dup_lines", "f.w.n_repeat_words", "f.text_key")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return f.withColumn("base_failed", failed)


def _log_factorial(x: Column) -> Column:
    x = x.cast("double")
    stirling = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials of chance p; 1 where k >= n p, for which no test is asked.

    Terms fall from k downwards faster than a geometric row; they are summed until far below rounding, a
    number that grows with the root of n only.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, (60 + 40 * F.sqrt(n * p)).cast("long"))
    step = lambda acc, i: F.struct((acc["t"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)).cast("double").alias("t"), (acc["s"] + acc["t"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)).cast("double").alias("s"))
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    sums = F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)).cast("long")), one, step, lambda acc: acc["s"]))
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * sums))


def stratum(n_words: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(STRATA, 1):
        out = F.when(n_words >= low, k).otherwise(out)
    return out


def ratio(rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.least(F.lit(1.0), F.col(top) / F.greatest(F.col(bottom), F.lit(1)))


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): reject above the cutoff. At most strata times rules rows; none where no test passes.

    labels(doc_id, quality): only rows outside the fold held_out() count, so that the fold can judge the result. Of
    several labels of a doc_id, or of equal texts, the smallest counts; null labels count as none.
    """
    budget, level = alpha / len(RULES), delta / (len(RULES) * (len(STRATA) + 1))
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality").isNotNull() & ~held_out("doc_id"))
    rows = feats.where(~F.col("base_failed")).select("doc_id", "text_key", stratum(F.col("n_words")).alias("stratum"), *(ratio(r).alias(r) for r in RULES)).join(known, "doc_id")
    rows = rows.groupBy("text_key", "stratum", *RULES).agg(F.min("quality").alias("quality")).where("quality = 1")
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * GRID).cast("int").alias("bin")) for r in RULES)))
    hist = rows.select("stratum", pairs.alias("b")).groupBy("stratum", "b.rule", "b.bin").agg(F.count(F.lit(1)).alias("c"))
    # a row of bin b is rejected by the cutoffs g / GRID with g < b
    grid = hist.groupBy("stratum", "rule").agg(F.sum("c").alias("n")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    full = grid.join(hist, ["stratum", "rule", "bin"], "left")
    down = Window.partitionBy("stratum", "rule").orderBy(F.col("bin").desc())
    k = F.coalesce(F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tested = full.withColumn("k", k).withColumn("fails", (binomial_tail(F.col("k"), F.col("n"), budget) > level).cast("int"))
    tested = tested.withColumn("failed", F.max("fails").over(down))
    return tested.where("failed = 0").groupBy("stratum", "rule").agg((F.min("bin") / GRID).alias("cutoff"))


def judge(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """feats with kept: false if base_failed, or if a ratio is above its stratum's cutoff (none: no rejection)."""
    by_stratum = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    # at most one row for each stratum
    j = feats.withColumn("stratum", stratum(F.col("n_words"))).join(F.broadcast(by_stratum), "stratum", "left")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(ratio(r) > F.try_element_at("cuts", F.lit(r)), F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & ~bad).drop("cuts", "stratum")


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """features() of docs with kept. Features are computed once and staged as narrow rows."""
    feats = staged(features(docs), "features")
    return judge(feats, cutoffs(feats, labels.select("doc_id", "quality"), alpha, delta))


#: verdicts() with the defaults. crc32 goes bit by bit over the digits of doc_id; the binomial tail is summed term by term.
SQL = """
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    e AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM e WHERE len(ws) >= 3)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
    rep AS (SELECT rid, CAST(sum(least(3, coalesce(i - before, 3))) AS BIGINT) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
    f AS (SELECT e.rid, doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM e LEFT JOIN rep USING (rid)),
    g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words >= 800 THEN 2 WHEN n_words >= 200 THEN 1 ELSE 0 END AS stratum,
                 {'symbols': least(CAST(1 AS DOUBLE), CAST(n_symbols AS DOUBLE) / greatest(word_chars, 1)), 'dup_lines': least(CAST(1 AS DOUBLE), CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1)), 'repeats': least(CAST(1 AS DOUBLE), CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1))} AS r FROM f),
    known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    fold AS (SELECT doc_id, quality, xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, CAST(ascii(b) AS BIGINT))), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM known),
    good AS (SELECT t, stratum, any_value(r) AS r FROM g JOIN fold USING (doc_id) WHERE NOT base_failed AND crc % 5 <> 0 GROUP BY t, stratum HAVING min(quality) = 1),
    bins AS (SELECT stratum, u.rule, CAST(ceil(u.x * 100) AS INTEGER) AS bin FROM (SELECT stratum, unnest([{'rule': 'symbols', 'x': r.symbols}, {'rule': 'dup_lines', 'x': r.dup_lines}, {'rule': 'repeats', 'x': r.repeats}]) AS u FROM good)),
    grid AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (bin > cut) AS k FROM bins, (SELECT unnest(range(0, 101)) AS cut) GROUP BY ALL),
    tested AS (SELECT *, CASE WHEN k >= n * (0.02 / CAST(3 AS DOUBLE)) THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02 / CAST(3 AS DOUBLE)) + (n - i) * ln(1 - 0.02 / CAST(3 AS DOUBLE))))) END > CAST(0.05 AS DOUBLE) / 9 AS fails FROM grid),
    cuts AS (SELECT stratum, rule, min(cut) / CAST(100 AS DOUBLE) AS cutoff FROM (SELECT *, bool_or(fails) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS failed FROM tested) WHERE NOT failed GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(r.symbols > (SELECT cutoff FROM cuts WHERE cuts.stratum = g.stratum AND rule = 'symbols'), false) AND NOT coalesce(r.dup_lines > (SELECT cutoff FROM cuts WHERE cuts.stratum = g.stratum AND rule = 'dup_lines'), false)
               AND NOT coalesce(r.repeats > (SELECT cutoff FROM cuts WHERE cuts.stratum = g.stratum AND rule = 'repeats'), false) AS kept
    FROM g
"""
