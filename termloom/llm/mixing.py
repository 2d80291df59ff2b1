"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

1. Every source gets a target number of words: shares of the mix by weight, none above `most` times its
   own words, the excess reshared by weight (closed form of that filling: sources in the order in which
   they fill up).
2. Within a source a document's expected copies grow with the bit length of its size, up to `most`, so
   that expected words meet the target. Its whole part is certain; the rest is its inclusion probability p.
3. Documents with p > 0 are ranked by Pareto's variable (u / (1 - u)) / (p / (1 - p)), u from a digest of
   doc_id; rows that share a doc_id, or have none, draw by a digest of all their columns and a number among
   equal rows. The first in that order are taken until the words that remain are spent; a last document,
   the one whose size is nearest to what is left, closes the gap.

The order is never sorted as a whole: the ranks are binned twice (4096 bins each), the bin where the
words run out is found from the bins' sums, and only that bin's rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import WORD_GAP, repeated, staged, unstage

BINS = 4096


def n_words(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), WORD_GAP, -1)) - 2, F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(src, source_size, target, full) from sizes(src, source, source_size), one row for each source.

    Weights go round over the sources by code point, null last. Only sums by source meet in the one task
    that numbers them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    w = sizes.withColumn("w", pick.cast("long"))
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(share)
    before = F.coalesce(F.sum(F.col("source_size") * most).over(filling), F.lit(0))
    left_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(filling), F.lit(0))
    full = (total - before) * F.col("w") >= F.col("source_size") * most * left_w
    w = w.withColumn("total", total).withColumn("full", full)
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * most)).over(every), F.lit(0))
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise((F.col("total") - taken) * F.col("w") / open_w)
    return w.select("src", "source_size", target.alias("target"), "full")


def _with_draws(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with mix_draw, a text that is another one for each row: the id where no other row has it, else a digest and a number."""
    name = F.col(f"`{id_col}`").cast("string")
    named = docs.withColumn("mix_draw", name)
    again = staged(named.select("mix_draw").groupBy("mix_draw").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR mix_draw IS NULL").select(F.coalesce("mix_draw", F.lit("")).alias("mix_again"), F.col("mix_draw").isNull().alias("mix_none")), "again")
    if again.isEmpty():
        unstage(again)
        return named
    same = (F.coalesce("mix_draw", F.lit("")) == F.col("mix_again")) & (F.col("mix_draw").isNull() == F.col("mix_none"))
    single = named.join(again, same, "left_anti")
    # equal rows are counted, then given back as often, so that no group is gathered
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))
    equal = named.join(again, same, "left_semi").select(F.struct(*columns).alias("mix_row"), digest.alias("mix_digest"))
    counted = equal.groupBy("mix_digest").agg(F.first("mix_row").alias("mix_row"), F.count(F.lit(1)).alias("mix_n"))
    each = repeated(counted, "mix_n", "mix_copy").select("mix_row.*", F.concat_ws(":", "mix_digest", F.col("mix_copy").cast("string")).alias("mix_draw"))
    return single.unionByName(staged(each, "repeats"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies: how often the mix takes each row.

    Null and blank texts have size 0 and are taken as their source's certain copies say; a null source is a
    source by itself. Rows that repeat a doc_id, or have none, are taken or left each by itself; of rows equal in all columns
    a number is taken, and which of them can't be told. Reruns agree: nothing but the rows' content decides. An
    empty table gives an empty table. Columns of docs keep their names, whatever these are, but for mix_*.
    """
    docs = _with_draws(docs, id_col)
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    key = F.col("mix_draw")
    half = F.conv(F.substring(F.md5(F.col("k").cast("binary")), 1, 13), 16, 10).cast("double")
    band = F.length(F.bin(F.col("mix_size")))
    extra = {"mix_src": src, "mix_size": n_words(F.col(text_col)), "mix_id": key}
    narrow = staged(docs.select(F.col(source_col).alias("source"), *(c.alias(k) for k, c in extra.items())).withColumn("mix_band", band), "mix")

    bands = staged(narrow.groupBy("mix_src", "mix_band").agg(F.first("source").alias("source"), F.sum("mix_size").alias("words")), "bands")
    per_source = bands.groupBy(F.col("mix_src").alias("src")).agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(per_source, list(weights), share, most)

    up = Window.partitionBy("src").orderBy(F.col("mix_band").desc())
    above = F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum(F.col("words") * F.col("mix_band")).over(Window.partitionBy("src").orderBy("mix_band"))
    b = bands.drop("source").withColumnRenamed("mix_src", "src").join(targets, "src")
    b = b.withColumn("capped", F.col("full") | ((F.col("target") - above) * F.col("mix_band") >= rest * most))
    all_of = Window.partitionBy("src")
    free = F.sum(F.when(~F.col("capped"), F.col("words") * F.col("mix_band"))).over(all_of)
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("words") * most)).over(all_of), F.lit(0))
    copies = F.when(F.col("capped"), F.lit(float(most))).otherwise(F.coalesce((F.col("target") - spent) * F.col("mix_band") / free, F.lit(0.0)))
    b = b.withColumn("copies", copies).withColumn("sure", F.floor("copies")).withColumn("p", F.col("copies") - F.floor("copies"))
    b = staged(b.withColumn("goal", F.sum(F.col("p") * F.col("words")).over(all_of)).select("src", "mix_band", "source_size", "target", "sure", "p", "goal"), "rates")

    def ranked(df: DataFrame) -> DataFrame:
        u = (half + 0.5) / F.lit(float(2**52))
        q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
        return df.withColumn("x", F.when(F.col("p") > 0, q / (1 + q)))

    r = narrow.drop("source").withColumnRenamed("mix_src", "src").withColumnRenamed("mix_id", "k")
    r = ranked(r.join(b, ["src", "mix_band"])).where("x IS NOT NULL").select("src", "goal", "x", F.col("k"), F.col("mix_size"))
    fine = F.floor(F.col("x") * F.lit(float(BINS * BINS)))
    r = r.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / BINS))

    def edge(rows: DataFrame, bins: str, start: Column) -> DataFrame:
        """For each source the bin where the goal is passed, and the words before it."""
        sums = rows.groupBy("src", bins).agg(F.sum("mix_size").alias("words"), F.first("goal").alias("goal"), F.first(start).alias("start"))
        upto = F.col("start") + F.sum("words").over(Window.partitionBy("src").orderBy(bins))
        over = sums.withColumn("upto", upto).where("upto > goal")
        return over.groupBy("src").agg(F.min(bins).alias("edge"), F.min_by(F.col("upto") - F.col("words"), bins).alias("before"))

    one = staged(edge(r, "coarse", F.lit(0)), "edge")
    in_one = r.join(one, "src").where("coarse = edge").drop("edge")
    two = staged(edge(in_one, "fine", F.col("before")), "edge")
    in_two = r.join(two, "src").where("fine = edge")
    place = F.struct("x", "k", "mix_size")
    run = F.col("before") + F.sum("mix_size").over(Window.partitionBy("src").orderBy("x", "k", "mix_size"))
    inside = in_two.withColumn("run", run).where("run <= goal").groupBy("src").agg(F.max(place).alias("last"), F.max("run").alias("reached"))
    cut = staged(two.join(inside, "src", "left").select("src", "edge", "last", F.coalesce("reached", "before").alias("reached")), "cut")

    def chosen() -> Column:
        """Before the place where the words run out; all, where they don't."""
        return F.col("edge").isNull() | (F.floor(F.col("x") * F.lit(float(BINS * BINS))) < F.col("edge")) | F.coalesce(F.struct("x", "k", "mix_size") <= F.col("last"), F.lit(False))

    gap = F.col("goal") - F.col("reached")
    off = F.abs(F.col("mix_size") - gap)
    closing = r.join(cut, "src").where(~chosen()).where(off < gap).groupBy("src").agg(F.min(F.struct(off.alias("off"), F.col("x"), F.col("k"), F.col("mix_size"))).alias("closing"))
    rates = b.join(cut.join(closing, "src", "left").select("src", "edge", "last", "closing"), "src", "left")
    rates = staged(rates, "rates")

    names = {c: f"mix_in_{i}" for i, c in enumerate(docs.columns) if c != "mix_draw"}
    held = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col("mix_draw").alias("k"))
    source, text = (F.col(names[c]) for c in (source_col, text_col))
    out = held.withColumn("src", F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).withColumn("mix_size", n_words(text))
    out = ranked(out.withColumn("mix_band", F.length(F.bin(F.col("mix_size")))).join(rates, ["src", "mix_band"]))
    closes = F.coalesce(F.struct("x", "k", "mix_size") == F.struct("closing.x", "closing.k", "closing.mix_size"), F.lit(False))
    extra = F.when(F.col("x").isNotNull() & (chosen() | closes), 1).otherwise(0)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (F.col("sure") + extra).cast("long").alias("mix_copies"))


SQL = """
    WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS src, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
                      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
    e AS (SELECT *, length(bin(size)) AS band FROM d),
    s AS (SELECT src, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
    f AS (SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total,
                 coalesce(sum(source_size * 2) OVER fill, 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER fill, 0) AS left_w
          FROM w WINDOW fill AS (ORDER BY source_size / CAST(w AS DOUBLE), src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, (total - before) * w >= source_size * 2 * left_w AS is_full FROM f),
    t AS (SELECT src, source_size, is_full, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE)
                 ELSE (total - coalesce(sum(source_size * 2) FILTER (is_full) OVER (), 0)) * w / sum(w) FILTER (NOT is_full) OVER () END AS target FROM g),
    b AS (SELECT src, band, sum(size) AS words FROM e GROUP BY src, band),
    c AS (SELECT b.*, target, is_full OR (target - 2 * coalesce(sum(words) OVER (PARTITION BY src ORDER BY band DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * band
                 >= sum(words * band) OVER (PARTITION BY src ORDER BY band) * 2 AS capped FROM b JOIN t USING (src)),
    r AS (SELECT *, CASE WHEN capped THEN 2.0 ELSE coalesce((target - coalesce(sum(words * 2) FILTER (capped) OVER (PARTITION BY src), 0)) * band
                 / sum(words * band) FILTER (NOT capped) OVER (PARTITION BY src), 0) END AS copies FROM c),
    q AS (SELECT *, floor(copies) AS sure, copies - floor(copies) AS p FROM r),
    h AS (SELECT *, sum(p * words) OVER (PARTITION BY src) AS goal FROM q),
    u AS (SELECT e.*, sure, p, goal, (CAST('0x' || substr(md5(k), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u FROM e JOIN h USING (src, band)),
    o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u),
    x AS (SELECT *, q / (1 + q) AS x FROM o),
    run AS (SELECT *, sum(size) FILTER (p > 0) OVER (PARTITION BY src ORDER BY p = 0, x, k, size) <= goal AS first_ones FROM x),
    z AS (SELECT *, p > 0 AND first_ones AS chosen FROM run),
    gap AS (SELECT src, any_value(goal) - coalesce(sum(size) FILTER (chosen), 0) AS gap FROM z GROUP BY src),
    near AS (SELECT src, min({'off': abs(size - gap), 'x': x, 'k': k, 'size': size}) AS closing FROM z JOIN gap USING (src) WHERE p > 0 AND NOT chosen AND abs(size - gap) < gap GROUP BY src)
    SELECT doc_id, size, source_size, target,
           CAST(size * (sure + CASE WHEN chosen OR (p > 0 AND closing IS NOT NULL AND x = closing.x AND k = closing.k AND size = closing.size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM z JOIN t USING (src) LEFT JOIN near USING (src)
"""
