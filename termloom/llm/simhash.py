"""SimHash fingerprints and Hamming search by permuted block tables, in DataFrame operations alone.

Terms are pairs of neighbouring words (and the last word alone); each occurrence votes with a weight that
grows with its length on the signed bits of its hash. Votes are counted in 16-bit lanes of packed longs, so
that BITS / 4 plain sums make a fingerprint, within chunks short enough that no lane overflows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import WORD_GAP, let, repeated, staged

BITS = 128
_LANES = 0x0001000100010001
#: Terms of a chunk; with weights up to 7 their votes stay below 2**15, so that the topmost lane never meets the sign.
CHUNK = 4096
#: Bits within which fingerprints count as near (6 of 128: a cosine of some 0.99 between term vectors), and blocks that a table takes
#: of the RADIUS + SPARE: keys are of 32 bits, and there are 28 tables.
RADIUS, SPARE = 6, 2


def _terms(text: Column) -> Column:
    """(w, v) for each word and the one after it; the last word with a null v."""
    split = F.split(F.concat(F.lit("x "), text, F.lit(" x")), WORD_GAP, -1)
    inner = let(split, lambda w: F.slice(w, 2, F.size(w) - 2))
    return let(inner, lambda w: F.arrays_zip(w.alias("w"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("v")))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and fp (array of BITS / 64 longs; zeros for a text without words), one row for each distinct keys.

    rows should already be dealt out by some of keys; then nothing is shuffled.
    """
    each = rows.select(*keys, F.posexplode_outer(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("at", "term"))
    w, v = F.col("term.w"), F.col("term.v")
    weight = F.coalesce(F.least(F.lit(7), 1 + F.shiftright(F.length(w) + F.coalesce(F.length(v), F.lit(0)), 1)).cast("long"), F.lit(0).cast("long"))
    halves = [F.xxhash64(F.lit(half), w, v).alias(f"h{half}") for half in range(BITS // 64)]
    each = each.select(*keys, (F.coalesce(F.col("at"), F.lit(0)) / CHUNK).cast("int").alias("chunk"), weight.alias("weight"), *halves)
    votes = [F.sum(F.col("weight") * F.shiftrightunsigned(f"h{half}", k).bitwiseAND(F.lit(_LANES))).alias(f"s{half}_{k}") for half in range(BITS // 64) for k in range(16)]
    sums = each.groupBy(*keys, "chunk").agg(F.sum("weight").alias("weight"), *votes)
    lanes = F.array(*(f"s{half}_{k}" for half in range(BITS // 64) for k in range(16)))
    whole = sums.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.collect_list(lanes).alias("lanes"))

    def half_of(half: int) -> Column:
        def bit(i: Column) -> Column:
            # lane i div 16 of the sum shifted by i mod 16 holds the votes of bit i
            lane = lambda chunk: _lane(F.get(chunk, i % 16 + 16 * half), i)
            return F.aggregate("lanes", F.lit(0).cast("long"), lambda acc, chunk: acc + lane(chunk)) * 2 > F.col("weight")

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: F.when(bit(i), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc))

    return whole.select(*keys, F.array(*(half_of(h) for h in range(BITS // 64))).alias("fp"))


def _lane(packed: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", packed, (F.floor(i / 16) * 16).cast("int")).bitwiseAND(F.lit(0xFFFF))


def spell(fp: Column) -> Column:
    """A fingerprint in hexadecimal."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    bits = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITS // 64)]
    return sum(bits[1:], bits[0])


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


#: Rows of a key that one place compares, about; share of the fingerprints in the sample that tells keys with more.
PLACE, SAMPLE = 1024, 64


def _blocks(fp: Column, n: int) -> list[Column]:
    """The n blocks of a fingerprint as numbers, from the upper bits on."""
    cuts = [BITS * k // n for k in range(n + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        parts = []
        for half in range(lo // 64, (hi - 1) // 64 + 1):
            a, b = max(lo - 64 * half, 0), min(hi - 64 * half, 64)
            bits = F.shiftrightunsigned(F.get(fp, F.lit(half)), 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
            parts.append(bits)
        out.append(parts)
    return [p[0] if len(p) == 1 else F.xxhash64(*p) for p in out]


def _entries(df: DataFrame, fp: str, radius: int, spare: int) -> DataFrame:
    """df with an entry (table, key) for each choice of `spare` of the radius + spare blocks of the fingerprint."""
    n = radius + spare
    kept, named = df.columns, df.select("*", *(b.alias(f"block_{k}") for k, b in enumerate(_blocks(F.col(fp), n))))
    tables = combinations(range(n), spare)
    entry = F.array(*(F.struct(F.lit(t).alias("table"), F.xxhash64(*(f"block_{k}" for k in table)).alias("key")) for t, table in enumerate(tables)))
    return named.select(*kept, F.explode(entry).alias("entry")).select(*kept, "entry.*")


def _first_table(a: Column, b: Column, radius: int, spare: int) -> Column:
    """The first table in which two fingerprints agree: that of the first `spare` blocks without a difference."""
    n = radius + spare
    cuts = [BITS * k // n for k in range(n + 1)]
    masks = [[sum(1 << (63 - i % 64) for i in range(cuts[k], cuts[k + 1]) if i // 64 == half) for half in range(BITS // 64)] for k in range(n)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    off = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))

    def of(d: Column) -> Column:
        same = [F.lit(True) for _ in range(n)]
        for k in range(n):
            for half, m in enumerate(masks[k]):
                if m:
                    same[k] = same[k] & (F.get(d, F.lit(half)).bitwiseAND(F.lit(signed(m))) == 0)
        found = F.lit(-1)
        for t, table in reversed(list(enumerate(combinations(range(n), spare)))):
            whole = same[table[0]]
            for k in table[1:]:
                whole = whole & same[k]
            found = F.when(whole, t).otherwise(found)
        return found

    return let(off, of)


def search(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """(query_id, id, distance) of all rows(id, fp) within radius of queries(query_id, fp), one by one: for queries with few matches.

    Where groups of near copies are large, neighbours() counts them instead. The tables are those of neighbours().
    """
    left = _entries(queries.where("fp IS NOT NULL").select(F.col("fp").alias("qfp")).distinct(), "qfp", radius, spare)
    right = _entries(rows.where("fp IS NOT NULL").select("fp").distinct(), "fp", radius, spare)
    pairs = left.join(right, ["table", "key"]).withColumn("distance", distance(F.col("qfp"), F.col("fp"))).where(F.col("distance") <= radius)
    pairs = pairs.where(_first_table(F.col("qfp"), F.col("fp"), radius, spare) == F.col("table")).select("qfp", "fp", "distance")
    found = pairs.join(queries.select("query_id", F.col("fp").alias("qfp")), "qfp").join(rows.select("id", "fp"), "fp")
    return found.select("query_id", "id", "distance")


def neighbours(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """What rows(id, fp) hold within radius of each distinct fingerprint of queries(fp): fp, n (rows), first_id (the smallest id), nearest
    (the smallest distance but for equal fingerprints; null if there are none).

    Fingerprints are cut into radius + spare blocks. Two within the radius agree in at least `spare` of them, so there is a
    table for each choice of that many blocks, keyed by them; each match is verified, and counts in the first table in
    which the two agree. Rows of equal fingerprints are one entry with a count. Entries of a key lie in places of
    about PLACE by their other bits (a sample tells which keys need several), a query goes to each place of its keys, and a place
    answers with one row a query: no pairs are made, and no key is read by one task. Null fingerprints match nothing; ids may be
    null (then they count, but are never the first) or repeat.
    """
    classes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    entries = _entries(classes, "fp", radius, spare)
    some = entries.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("table", "key").agg(F.count(F.lit(1)).alias("c"))
    wide = some.where(F.col("c") > PLACE // SAMPLE).select("table", "key", F.ceil(F.col("c") * SAMPLE / PLACE).cast("int").alias("places"))
    wide = staged(wide, "places")
    place = F.coalesce(F.pmod(F.xxhash64(F.lit("place"), "fp"), F.col("places")), F.lit(0)).cast("int")
    held = entries.join(wide, ["table", "key"], "left").withColumn("place", place)
    held = held.groupBy("table", "key", "place").agg(F.collect_list(F.struct("fp", "n", "first_id")).alias("held"))
    asked = _entries(queries.where("fp IS NOT NULL").select(F.col("fp").alias("qfp")).distinct(), "qfp", radius, spare).join(wide, ["table", "key"], "left")
    asked = asked.withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1))).drop("places")
    kind = rows.schema["id"].dataType
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(kind).alias("first_id"), F.lit(None).cast("int").alias("nearest"))

    def add(acc: Column, x: Column) -> Column:
        d = distance(F.col("qfp"), x["fp"])
        hit = (d <= radius) & (_first_table(F.col("qfp"), x["fp"], radius, spare) == F.col("table"))
        more = F.struct((acc["n"] + x["n"]).alias("n"), F.least(acc["first_id"], x["first_id"]).alias("first_id"), F.least(acc["nearest"], F.when(d > 0, d)).alias("nearest"))
        return F.when(hit, more).otherwise(acc)

    met = asked.join(held, ["table", "key", "place"]).select("qfp", F.aggregate("held", none, add).alias("m"))
    out = met.groupBy("qfp").agg(F.sum("m.n").alias("n"), F.min("m.first_id").alias("first_id"), F.min("m.nearest").alias("nearest"))
    return out.withColumnRenamed("qfp", "fp")


#: Buckets of ids at most, and sampled ids for each.
BUCKETS, PER_BUCKET_SAMPLED = 65536, 32


def _cuts(ids: DataFrame, buckets: int, n: int) -> tuple[list[str], list[str]]:
    """Where to cut the order of id into about that many equal buckets, as JSON values in order, from a sample of at most buckets *
    PER_BUCKET_SAMPLED ids; and the ids that fill several buckets by themselves. Bad luck in sampling makes buckets uneven, nothing else."""
    if buckets < 2:
        return [], []
    share = min(1.0, buckets * PER_BUCKET_SAMPLED / max(n, 1))
    some = ids.where("id IS NOT NULL")
    some = some if share == 1.0 else some.sample(share, 9)
    tiles = some.select("id", F.ntile(buckets).over(Window.orderBy("id")).alias("tile")).groupBy("tile").agg(F.min("id").alias("id"))
    firsts = [r["j"] for r in tiles.orderBy("tile").select(F.to_json(F.array("id")).alias("j")).collect()]
    firsts = [j[1:-1] for j in firsts]
    hot = sorted({a for a, b in zip(firsts, firsts[2:]) if a == b})
    return list(dict.fromkeys(firsts[1:])), hot


def _literal(values: str, kind: str) -> Column:
    return F.from_json(F.lit(values), kind)


def _bucket(cuts: list[str], kind: str, value: Column) -> Column:
    """How many of the cuts are at most the value: a look into every 256th, then into those between."""
    if not cuts:
        return F.lit(0)
    blocks = [cuts[k : k + 256] for k in range(0, len(cuts), 256)]
    tops = _literal("[" + ",".join(b[0] for b in blocks) + "]", f"array<{kind}>")
    grid = _literal("[" + ",".join("[" + ",".join(b) + "]" for b in blocks) + "]", f"array<array<{kind}>>")
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    inner = lambda i: F.when(i == 0, 0).otherwise((i - 1) * 256 + upto(F.get(grid, i - 1)))
    return let(upto(tops), inner)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 1000) -> tuple[DataFrame, bool]:
    """Rows (bucket, n, id, text, copies, next_text, guard): each row with the text of the next, ascending id; after the last, the first.

    Equal ids go by a hash of the text, then the text; null ids come last; a null text counts as empty. ids may have any type that has an
    order. Rows are dealt out whole by buckets of about per_bucket rows (BUCKETS at most), cut at sampled quantiles of the id, so texts
    are shuffled once and no stretch of ids, however crowded, comes to one task. An id that fills several buckets (or no id) is cut by
    the text's hash instead, its equal rows counted in `copies`: all but the last of them have themselves as next. The first
    row of a bucket also stands as a guard at the end of the bucket before it. And whether any `copies` may be above 1.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ids = named.select("id")
    counted = ids.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("named")).first()
    n = counted["n"]
    buckets = min(BUCKETS, max(1, -(-n // per_bucket)))
    size = -(-n // buckets) if n else 1
    cuts, hot = _cuts(ids, buckets, n)
    null_hot = n - counted["named"] > 2 * size
    is_hot = F.coalesce(F.array_contains(_literal("[" + ",".join(hot) + "]", f"array<{kind}>"), F.col("id")), F.lit(False)) if hot else F.lit(False)
    is_hot = is_hot | (F.col("id").isNull() & F.lit(null_hot))
    plain = named.where(~is_hot).select("id", F.lit(0).cast("long").alias("h"), "text", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("cell"))
    rows = plain
    if hot or null_hot:
        # cells of a hot id: as many as it would fill, by the hash's upper bits
        held = named.where(is_hot).groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
        held = staged(held.select("id", F.xxhash64("text").alias("h"), "text", "copies"), "hot-ids")
        cells = held.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("cells"))
        cells = cells.select(F.col("id").alias("hot_id"), "cells")
        held = held.join(F.broadcast(cells), F.col("id").eqNullSafe(F.col("hot_id")))  # no more rows than buckets
        cell = F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * F.col("cells")).cast("long")
        rows = plain.unionByName(held.select("id", "h", "text", "copies", F.least(cell, F.col("cells") - 1).alias("cell")))
    # a hot id's cells come behind one another, and behind the other ids of its bucket: the bucket's number is (number, id is hot, id, cell)
    number = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(_bucket(cuts, kind, F.col("id")))
    crowded = F.lit(False) if not hot else F.coalesce(F.array_contains(_literal("[" + ",".join(hot) + "]", f"array<{kind}>"), F.col("id")), F.lit(False))
    bucket = F.struct(number.cast("int").alias("k"), F.when(crowded, F.lit(1)).otherwise(F.lit(0)).alias("hot"), F.when(crowded, F.col("id")).alias("own"), F.col("cell").alias("cell"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    heads = rows.select(bucket.alias("bucket"), order.alias("ord")).groupBy("bucket").agg(F.min("ord").alias("first"))
    by_place = Window.orderBy("first")
    heads = heads.select(F.col("bucket").alias("place"), "first", F.row_number().over(by_place).alias("bucket"), F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("last"))
    heads = heads.select("place", "first", "bucket", F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.col("last")).alias("prior"), (F.col("bucket") == 1).alias("wraps"))
    # no more rows than buckets
    placed = rows.withColumn("place", bucket).withColumn("ord", order).join(F.broadcast(heads), "place")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guard"), F.lit(False).alias("after"))
    guard = F.struct(F.col("prior").alias("bucket"), F.lit(True).alias("guard"), F.col("wraps").alias("after"))
    places = F.when(F.col("ord") == F.col("first"), F.array(own, guard)).otherwise(F.array(own))
    dealt = placed.select("id", "ord", "text", "copies", F.explode(places).alias("p")).select("id", "ord", "text", "copies", "p.*")
    w = Window.partitionBy("bucket").orderBy("after", "guard", "ord", "text")
    return dealt.withColumn("n", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w)).drop("ord", "after"), bool(hot or null_hot)


def edited(text: Column, nxt: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of nxt."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(nxt, F.lit("")), F.lit(1), half))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, efp (fingerprints of the text and of its edited form), near_edited, near_next.

    A null text counts as empty; texts without words have the fingerprint zero. Rows stay one to one: those that repeat an id go
    by their texts, and an equal one's next is its like.
    """
    rows, crowded = with_next(docs, id_col, text_col)
    rows = rows.withColumn("edited", F.when(~F.col("guard"), edited(F.col("text"), F.col("next_text"))))
    keys, forms = ["bucket", "n", "guard", "id", "n_chars", "sha"], ["text", "edited"]
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("sha", sha("edited"))
    if crowded:
        rows = rows.withColumn("twice", F.when(~F.col("guard") & (F.col("copies") > 1), edited(F.col("text"), F.col("text")))).withColumn("sha_twice", sha("twice"))
        keys, forms = [*keys, "copies", "sha_twice"], [*forms, "twice"]
    every = F.filter(F.array(*(F.struct(F.lit(k).alias("which"), F.col(c).alias("t")) for k, c in enumerate(forms))), lambda x: x["t"].isNotNull())
    each = rows.select(*keys, F.explode(every).alias("x")).select(*keys, "x.which", "x.t")
    marks = fingerprints(each, [*keys, "which"], "t")
    of = lambda k, name: F.max(F.when(F.col("which") == k, F.col("fp"))).alias(name)
    both = marks.groupBy(*keys).agg(of(0, "fp"), of(1, "efp"), of(2, "tfp"))
    w = Window.partitionBy("bucket").orderBy("n")
    out = both.withColumn("next_fp", F.lead("fp").over(w)).where("NOT guard")
    if crowded:
        out = staged(out, "crowded")
        shown = lambda sha, efp, nxt, times: F.struct(F.col(sha).alias("sha"), F.col(efp).alias("efp"), F.col(nxt).alias("next_fp"), times.alias("times"))
        kinds = F.filter(F.array(shown("sha", "efp", "next_fp", F.lit(1).cast("long")), shown("sha_twice", "tfp", "fp", F.col("copies") - 1)), lambda x: x["times"] > 0)
        out = repeated(out.select("id", "n_chars", "fp", F.explode(kinds).alias("k")).select("id", "n_chars", "fp", "k.*"), "times", "copy")
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), "fp", "efp", likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def compare(docs: DataFrame) -> DataFrame:
    """compared() with its fingerprints spelt out."""
    return compared(docs).select("doc_id", "n_chars", "edited_sha256", spell(F.col("fp")).alias("fingerprint"), spell(F.col("efp")).alias("edited_fingerprint"), "near_edited", "near_next")


def report(docs: DataFrame, radius: int = RADIUS, spare: int = SPARE, every: int = 20) -> DataFrame:
    """compare() with fingerprints spelt out, and for the rows whose doc_id is divisible by `every` (numeric ids) what neighbours() finds among all
    rows: n_within (rows within the radius, itself included), first_within (their smallest doc_id), nearest_within (the
    smallest distance but 0); null for all others."""
    marks = staged(compared(docs), "marks")
    number = F.col("doc_id").try_cast("long")
    asks = F.coalesce((number % every == 0) & (number.cast("string") == F.col("doc_id").cast("string")), F.lit(False))
    found = neighbours(marks.where(asks).select("fp"), marks.select(F.col("doc_id").alias("id"), "fp"), radius, spare)
    found = found.withColumnsRenamed({"n": "n_within", "first_id": "first_within", "nearest": "nearest_within"})
    answered = marks.where(asks).join(found, "fp")
    rest = marks.where(~asks).select("*", F.lit(None).cast("long").alias("n_within"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("first_within"), F.lit(None).cast("int").alias("nearest_within"))
    out = answered.select(rest.columns).unionByName(rest)
    return out.select("doc_id", "n_chars", "edited_sha256", spell(F.col("fp")).alias("fingerprint"), spell(F.col("efp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_within", "first_within", "nearest_within")
