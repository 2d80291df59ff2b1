"""Secret scans and multipart credential linking, in DataFrame operations alone.

Strong candidates are reported wherever they stand. Weak ones (identifiers, secrets and endpoints that
mean little by themselves) are reported only where complementary parts stand within one scope: a weak
secret beside an identifier, a weak identifier beside a secret, an endpoint beside both. Parts meet in
an interval join on (text, cell of the scope's width), each part with the cell it begins in and its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import let, running, staged

#: Fixed values of the contract: kind, pattern, group measured, least length of that group.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Cheap texts that a match needs; None: none is known, and a shorter pattern is tried instead.
NEEDS = {"assign": r"[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: Weak parts of this engine's own: kind, pattern, part played. A weak identifier's name may have a prefix (aws_, DB_);
#: a weak secret may follow = or : and end a sentence. A mail address says who logs in, capital hexadecimal digits may be a key, and a host
#: with a port is an endpoint.
WEAK = (
    ("weak_id", r"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_]*(?:access_?key_?id|client_?id|account_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}", "id"),
    ("weak_secret", r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=_-]|\.[A-Za-z0-9+/=_-])", "secret"),
    ("weak_endpoint", r"(?i)(?<![A-Za-z0-9_])(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", "endpoint"),
    ("weak_mail", r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9@-])", "id"),
    ("weak_key", r"(?<![A-Za-z0-9])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,}(?![A-Za-z0-9])", "secret"),
    ("weak_host", r"(?<![A-Za-z0-9.@/_-])(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z0-9-]{1,63}:[0-9]{2,5}(?![A-Za-z0-9:.])", "endpoint"),
)
WEAK_NEEDS = {"weak_id": r"[:=]", "weak_secret": r"[A-Za-z0-9+/]{24}", "weak_endpoint": r"://", "weak_mail": r"@", "weak_key": r"[0-9A-F]{32}", "weak_host": r"\.[A-Za-z0-9-]{1,63}:[0-9]{2}"}
KINDS = [k[0] for k in BASE] + [k[0] for k in WEAK]
#: The part that a strong candidate plays.
PLAYS = {"assign": "secret", "access": "id", "hex": "secret"} | {k: part for k, _, part in WEAK}
SCOPE = 400
SPANS = "array<struct<start:int,rank:int,end:int>>"


def find_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, rank of the kind, end) in code points of the leftmost non-overlapping matches; failing ones dropped."""
    need = (NEEDS | WEAK_NEEDS)[kind]
    sizes = lambda xs: F.transform(xs, lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # the last gap has no match after it
    rows = F.filter(F.arrays_zip(sizes(F.split(text, pattern, -1)).alias("gap"), sizes(whole).alias("own"), sizes(measured).alias("part")), lambda r: r["own"].isNotNull())

    def spans(rs: Column) -> Column:
        before = running(F.transform(rs, lambda r: r["gap"] + r["own"]), lambda a, b: a + b)
        every = F.zip_with(rs, before, lambda r, at: F.struct((at + r["gap"]).cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (at + r["gap"] + r["own"]).cast("int").alias("end"), (r["part"] >= least).alias("ok")))
        return F.transform(F.filter(every, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))).cast(SPANS)

    return F.when(text.rlike(need) & text.rlike(pattern), let(rows, spans)).otherwise(F.array().cast(SPANS))


def spell(spans: Column) -> Column:
    """kind:start:end in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts(key, spans of all kinds) to (key, linked): the weak spans with complementary parts within scope code points.

    A cell holds at most as many parts as code points, so no group grows with the data.
    """
    each = parts.select("key", F.explode("spans").alias("s")).select("key", "s.*")
    part = F.element_at(F.array(*(F.lit(PLAYS[k]) for k in KINDS)), F.col("rank") + 1)
    each = each.withColumn("part", part)
    # a part reaches all cells between its ends, so that long ones are met from either side
    cells = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))
    there = each.where("part <> 'endpoint'").select("key", cells.alias("cell"), F.col("part").alias("there"), F.col("start").alias("a"), F.col("end").alias("b")).distinct()
    reach = F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1))
    weak = each.where(F.col("rank") >= len(BASE)).select("key", "start", "rank", "end", "part", reach.alias("cell"))
    met = weak.join(there, ["key", "cell"]).where((F.col("a") < F.col("end") + scope) & (F.col("start") < F.col("b") + scope) & (F.col("part") != F.col("there")))
    roles = met.groupBy("key", "start", "rank", "end", "part").agg(F.max(F.col("there") == "id").alias("id"), F.max(F.col("there") == "secret").alias("secret"))
    enough = F.when(F.col("part") == "secret", F.col("id")).when(F.col("part") == "id", F.col("secret")).otherwise(F.col("id") & F.col("secret"))
    return roles.where(enough).groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secret_found: struct of base and weak spans, a key of the text, and whether links are possible.

    A weak part alone in its text, or beside parts of its own kind only, can't be linked.
    """
    def of(t: Column) -> Column:
        base = F.concat(*(find_spans(t, *k) for k in BASE))
        weak = F.concat(*(find_spans(t, kind, pattern, 0, 1) for kind, pattern, _ in WEAK))
        key = F.concat_ws(":", F.xxhash64(t).cast("string"), F.length(t).cast("string"))
        return let(F.struct(base.alias("base"), weak.alias("weak")), lambda f: F.struct(f["base"].alias("base"), f["weak"].alias("weak"), key.alias("key"), _linkable(f).alias("may")))

    return docs.withColumn("secret_found", let(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), of))


def _linkable(f: Column) -> Column:
    plays = F.array(*(F.lit(PLAYS[k]) for k in KINDS))
    roles = F.transform(F.concat(f["base"], f["weak"]), lambda s: F.element_at(plays, s["rank"] + 1))
    return (F.size(f["weak"]) > 0) & F.array_contains(roles, "id") & F.array_contains(roles, "secret")


def links(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, linked) of the texts in found, once for each distinct text (by a 64-bit hash and the length)."""
    f = F.col("secret_found")
    rows = found.where(f["may"]).select(f["key"].alias("key"), F.concat(f["base"], f["weak"]).alias("spans"))
    return link(rows.groupBy("key").agg(F.first("spans").alias("spans")), scope)


def resolve(found: DataFrame, linked: DataFrame) -> DataFrame:
    """found without secret_found, with secret_base and secret_spans (start, rank, end) sorted by start, then kind."""
    f = F.col("secret_found")
    plain = found.where(~f["may"]).withColumn("secret_linked", F.lit(None).cast(SPANS))
    rest = found.where(f["may"]).withColumn("secret_key", f["key"]).join(linked.select(F.col("key").alias("secret_key"), F.col("linked").alias("secret_linked")), "secret_key", "left").drop("secret_key")
    every = F.concat(f["base"], F.coalesce(F.col("secret_linked"), F.array().cast(SPANS)))
    return plain.unionByName(rest).withColumn("secret_base", F.array_sort(f["base"])).withColumn("secret_spans", F.array_sort(every)).drop("secret_found", "secret_linked")


def scan(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with secret_base and secret_spans.

    A null or empty text has none. Rows stay one to one, repeated ones and null ids included; columns other
    than text_col pass through, and the names secret_* are this operator's own. Texts are searched once: the rows are
    staged with what was found, and shuffled no more but for those of linkable rows.
    """
    found = staged(find(docs, text_col), "secret-found")
    return resolve(found, links(found, scope))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans. Texts are searched once; their spans are staged."""
    found = staged(find(docs.select(F.col(id_col).alias("doc_id"), text_col), text_col).drop(text_col), "secret-spans")
    out = resolve(found, links(found, scope))
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k[0]) for k in BASE), F.sha2(spell(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), spell(F.col("secret_spans")).alias("spans"))


#: Code points of a piece in which spans are cut out of a text.
PIECE = 4096


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with every one of its spans (sorted by start) replaced by mask, overlapping ones as one. Text is read in pieces and joined
    once, so a text of many spans costs no more than its length and their number."""

    def of(ps: Column, reach: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """The text from a to b: the end of one piece, whole ones, the beginning of another."""
            i, j = (a / PIECE).cast("int"), (b / PIECE).cast("int")
            here = F.substring(F.get(ps, i), a % PIECE + 1, b - a)
            ends = F.concat(F.substring(F.get(ps, i), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(ps, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(ps, j), F.lit(1), b % PIECE), F.lit("")))
            return F.when(b <= a, "").when(i == j, here).otherwise(ends)

        # a span that begins before what is masked already only carries the mask on
        cut = F.zip_with(spans, reach, lambda s, r: F.when(s["start"] < r, "").otherwise(F.concat(between(r, s["start"]), F.lit(mask))))
        last = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(cut, ""), between(last, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    whole = let(pieces, lambda ps: let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda reach: of(ps, reach)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text_col replaced by mask; overlapping spans are replaced as one. Null and empty texts stay."""
    done = masked(F.col(f"`{text_col}`"), F.col("secret_spans"), mask)
    return scan(docs, text_col).withColumn(text_col, done).drop("secret_base", "secret_spans")
