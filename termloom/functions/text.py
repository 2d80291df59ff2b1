"""Scalar text functions as Catalyst expressions, and the offset-keeping normaliser as a pandas UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.config import NormalizerConfig

# Dashes and apostrophes that count as "-" and "'", and letters and signs in ASCII spelling.
DASHES = "‐‑‒–—−"
APOSTROPHES = "‘’‛′`´"
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s",
    "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ј": "j", "љ": "lj", "њ": "nj", "ђ": "dj", "ћ": "tsh", "џ": "dzh", "ѕ": "dz", "ґ": "g",
}
LATIN = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ĸ": "k", "ŧ": "t", "⁄": "/", "±": "+-", "«": "<<", "»": ">>", "€": "EUR", "£": "PS", "°": "deg", "×": "x", "·": "*",
    "•": "*", "“": '"', "”": '"', "„": '"', "¡": "!", "¿": "?", "¢": "C/", "¦": "|", "§": "SS", "©": "(c)", "¬": "!", "®": "(r)", "¶": "P", "÷": "/",
}
#: Ideographs, which have no spelling of their own: u and their number. Characters from LAST on are spelled so too, if they are letters.
IDEOGRAPHS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2F7FF), (0x30000, 0x3FFFF))
LAST = 0x30000


def spelled(char: str) -> str:
    """A letter of another script by its Unicode name: the name's last word, of an alphabet's consonant what stands before its vowel."""
    name = unicodedata.name(char, "")
    kind = unicodedata.category(char)
    if kind[0] == "N" and unicodedata.digit(char, None) is not None:
        return str(unicodedata.digit(char))
    if not (kind[0] in "LN" or "VOWEL SIGN" in name) or not name:
        return " " if char.isspace() else ""
    word = "".join(c for c in re.split("[ -]", name)[-1].lower() if c.isascii() and c.isalnum())
    alphabet = name.split(" ")[0] in ("CYRILLIC", "HEBREW", "ARABIC", "ARMENIAN", "GEORGIAN", "COPTIC", "SYRIAC", "GREEK", "LATIN", "THAANA", "GOTHIC")
    start = re.match("[bcdfghjklmnpqrstvwxyz]+", word)
    return (start[0] if start else word[:1]) if alphabet and len(word) > 1 else word


@cache
def fold_char(char: str, lowercase: bool = True, strip_accents: bool = True) -> str:
    """One character in compatibility form, dashes and apostrophes unified, in ASCII if asked, in lower case if asked.

    In ASCII, letters of every script are spelled: Latin, Greek and Cyrillic ones by table, others by their names, ideographs by
    number. Signs without a spelling vanish.
    """
    out = []
    for c in unicodedata.normalize("NFKC", char):
        c = "-" if c in DASHES else "'" if c in APOSTROPHES else c
        if strip_accents and ord(c) > 127:
            base = c if "가" <= c <= "힣" else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            ascii_ = []
            for x in base:
                low = x.lower()
                known = x if ord(x) < 128 else LATIN.get(low, GREEK.get(low, CYRILLIC.get(low)))
                if known is None:
                    number = ord(x)
                    listed = any(a <= number <= b for a, b in IDEOGRAPHS)
                    known = f"u{number:x}" if listed or (number >= LAST and unicodedata.category(x)[0] == "L") else spelled(low if len(low) == 1 else x)
                ascii_.append(known.upper() if x != low and known.isalpha() else known)
            c = "".join(ascii_)
        out.append(c)
    text = "".join(out)
    return text.lower() if lowercase else text


_OTHER = "[^\\x00-\\x7F]"
#: Code points of a cell of the table of expansions: one text, parts by U+001F.
CELL = 64


@cache
def _tables(lowercase: bool, strip_accents: bool) -> tuple[str, str, tuple[str, ...]]:
    """Characters of the basic plane that fold to one other, and what to; the rest of the folds by cells of CELL code points, where a part
    that is U+001E means that the character stays."""
    single, to, cells = [], [], []
    for low in range(0, LAST, CELL):
        parts = []
        for code in range(low, low + CELL):
            c = chr(code)
            known = not (0xD800 <= code < 0xE000 or unicodedata.category(c) == "Cn" or any(a <= code <= b for a, b in IDEOGRAPHS))
            f = fold_char(c, lowercase, strip_accents) if known else ""
            stays = f == c or (not known and not strip_accents)
            if len(f) == 1 and not stays and code < 0x10000:
                single.append(c)
                to.append(f)
            parts.append("\x1e" if stays else f if len(f) > 1 or code >= 0x10000 else "")
        cells.append("\x1f".join(parts) if any(parts) else "")
    return "".join(single), "".join(to), tuple(cells)


def fold(text: Column, cfg: NormalizerConfig = NormalizerConfig()) -> Column:
    """fold_char() of every character: a translation within codegen and, for texts that then have other characters yet, expansions."""
    single, to, cells = _tables(cfg.lowercase, cfg.strip_accents)
    # neighbouring equal cells, most of them empty, are told by their number
    places = {x: i for i, x in enumerate(dict.fromkeys(cells))}
    table = F.split(F.lit("\x1d".join(places)), "\x1d", -1)
    index = F.split(F.lit(",".join(str(places[x]) for x in cells)), ",").cast("array<int>")

    def one(c: Column) -> Column:
        code = F.ascii(c)
        part = F.get(F.split(F.get(table, F.get(index, F.floor(code / CELL).cast("int"))), "\x1f", -1), code % CELL)
        if not cfg.strip_accents:
            return F.when(code < 128, c).when(code >= LAST, c).otherwise(F.when(F.coalesce(part, F.lit("")) == "\x1e", c).otherwise(part))
        number = F.concat(F.lit("u"), F.lower(F.hex(code)))
        ideograph = F.lit(False)
        for a, b in IDEOGRAPHS:
            ideograph = ideograph | code.between(a, b)
        return F.when(code < 128, c).when(ideograph, number).when(code >= LAST, F.lit("")).otherwise(F.coalesce(part, F.lit("")))

    def expand(t: Column) -> Column:
        return F.when(t.rlike(_OTHER), F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), one), "")).otherwise(t)

    translated = F.element_at(F.transform(F.array(F.translate(text, single, to)), expand), 1)
    # most texts are ASCII, for which nothing but the grave accent and case is left to do
    t = F.replace(F.when(text.rlike(_OTHER), translated).otherwise(text), F.lit(APOSTROPHES[4]), F.lit("'"))
    return F.translate(t, ascii_uppercase, ascii_lowercase) if cfg.lowercase else t


def _kept(cfg: NormalizerConfig) -> str:
    return "\\p{L}\\p{N}_\\s\\x1C-\\x1F+\\-'." + "&" * cfg.keep_ampersand + "#" * cfg.keep_hash


SPACE = "[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F]+"


def normalize_e_numbers(text: Column, flag: str = "") -> Column:
    """'e 171' becomes 'e171'."""
    return F.regexp_replace(text, f"(?i){flag}\\b(e)[\\s\\x1C-\\x1F]+(\\d{{3,4}})\\b", "$1$2")


def normalize(text: Column, cfg: NormalizerConfig = NormalizerConfig()) -> Column:
    """Folded text, punctuation but + - ' . (and & # by option) to spaces, E-numbers joined, spaces collapsed. Null: ''."""
    flag = "" if cfg.strip_accents else "(?U)"
    t = F.regexp_replace(fold(F.coalesce(text, F.lit("")), cfg), f"{flag}[^{_kept(cfg)}]", " ")
    t = normalize_e_numbers(t, flag) if cfg.normalize_e_numbers else t
    return F.trim(F.regexp_replace(t, SPACE if cfg.strip_accents else "(?U)[\\s\\x1C-\\x1F]+", " "))


def normalize_for_id(text: Column) -> Column:
    """The normalised text as an identifier of [a-z0-9_]."""
    t = F.regexp_replace(F.replace(normalize(text), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")
    return F.trim(F.regexp_replace(t, "_+", "_"), F.lit("_"))


def base_name(name: Column) -> Column:
    """The text before the first '*', trimmed."""
    return F.trim(F.substring_index(F.trim(F.coalesce(name, F.lit(""))), "*", 1))


def display_name(language: Column | str, it: Column, en: Column) -> Column:
    language = F.lit(language) if isinstance(language, str) else language
    return F.when(language == "en", F.coalesce(F.nullif(en, F.lit("")), it)).otherwise(it)


def dictionary_key(text: Column) -> Column:
    t = F.trim(F.trim(text), F.lit(".,;:!?()[]{}"))
    return F.replace(F.regexp_replace(F.trim(t), "\\s+", " "), F.lit(" "), F.lit("_"))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The set of n-grams of the text's letters and digits; the whole of it if it is no longer than n."""
    c = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def informative_tokens(text: Column, stopwords: list[str]) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.array_except(tokens, F.array(*map(F.lit, stopwords))), lambda x: F.length(x) >= 2))


def dice(a: Column, b: Column) -> Column:
    """2 |a & b| / (|a| + |b|) of two arrays without repeats; 1 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def compact_length(text: Column) -> Column:
    return F.length(F.replace(text, F.lit(" "), F.lit("")))


def edit_score(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(compact_length(a), compact_length(b), F.lit(1))
    return F.greatest(F.lit(0.0), 1.0 - distance / longest)


def pseudo_distance(score: Column, a: Column, b: Column) -> Column:
    """The distance that a score stands for, rounded half to even."""
    longest = F.greatest(compact_length(a), compact_length(b), F.lit(1))
    return F.greatest(F.lit(0), F.bround((1.0 - score) * longest).cast("int"))


def running_offsets(lengths: Column, block: int = 128) -> Column:
    """The sums before each element, in two levels so that no long array is copied for each element."""
    ints = "array<int>"
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    scan = lambda xs, start: F.aggregate(xs, F.struct(start.cast("int").alias("at"), F.array().cast(ints).alias("out")), add, lambda acc: acc["out"])

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

        def inner(bs: Column) -> Column:
            sums = F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
            return F.flatten(F.zip_with(bs, scan(sums, F.lit(0)), scan))

        return F.element_at(F.transform(F.array(blocks), inner), 1)

    return F.when(F.size(lengths) == 0, F.array().cast(ints)).otherwise(F.element_at(F.transform(F.array(lengths), of), 1))


def runs_with_offsets(text: Column, pattern: str) -> Column:
    """(run, start) for every match of a pattern whose matches tile the whole text; starts are 0-based code points."""
    def of(runs: Column) -> Column:
        return F.arrays_zip(runs.alias("run"), running_offsets(F.transform(runs, lambda x: F.length(x))).alias("start"))

    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), of), 1)


MAPPED = T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.ArrayType(T.IntegerType()))])
_E_NUMBER = re.compile(r"\b(e)(\s+)(\d{3,4})\b", re.IGNORECASE)


class _Signs(dict):
    """str.translate()'s table of what each character is folded to, characters that aren't kept as spaces."""

    def __init__(self, cfg: NormalizerConfig):
        super().__init__()
        self.cfg, self.keep = cfg, "_+-'." + "&" * cfg.keep_ampersand + "#" * cfg.keep_hash

    def __missing__(self, code: int) -> str:
        out = "".join(f if f.isalnum() or f.isspace() or f in self.keep else " " for f in fold_char(chr(code), self.cfg.lowercase, self.cfg.strip_accents))
        self[code] = out
        return out


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = fold_char(chr(code))
        return out


_FOLDS = _Folds()


def fold_text(text: str) -> str:
    """fold_char() of every character of a text, as fold() has it."""
    return text.translate(_FOLDS)


@cache
def _signs(lowercase: bool, strip_accents: bool, keep_ampersand: bool, keep_hash: bool) -> _Signs:
    return _Signs(NormalizerConfig(lowercase=lowercase, strip_accents=strip_accents, keep_ampersand=keep_ampersand, keep_hash=keep_hash))


def _table(cfg: NormalizerConfig) -> _Signs:
    return _signs(cfg.lowercase, cfg.strip_accents, cfg.keep_ampersand, cfg.keep_hash)


def plain_text(text: str | None, cfg: NormalizerConfig = NormalizerConfig()) -> str:
    """The normalised text, as normalize() and map_text() have it."""
    folded = (text or "").translate(_table(cfg))
    return " ".join((_E_NUMBER.sub(r"\1\3", folded) if cfg.normalize_e_numbers else folded).split())


def places(text: str | None, cfg: NormalizerConfig = NormalizerConfig()) -> tuple[str, np.ndarray]:
    """The normalised text, and for each of its characters the index of the original one it came from."""
    text, table = text or "", _table(cfg)
    folded = text.translate(table)
    # an ASCII character folds to one; of other texts the characters are counted out
    at = np.arange(len(text)) if text.isascii() else np.repeat(np.arange(len(text)), [len(table[ord(c)]) for c in text])
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    if cfg.normalize_e_numbers and (found := [range(*m.span(2)) for m in _E_NUMBER.finditer(folded)]):
        drop = np.concatenate([np.arange(r.start, r.stop) for r in found])
        codes, at = np.delete(codes, drop), np.delete(at, drop)
    blank = np.isin(codes, [ord(c) for c in set(folded) if c.isspace()])
    # of neighbouring blanks the first stays, at the start and end none
    kept = ~blank | ~np.concatenate([[True], blank[:-1]]) if len(blank) else blank
    if kept.any() and blank[last := np.flatnonzero(kept)[-1]]:
        kept[last] = False
    codes = np.where(blank, 32, codes)[kept].astype(np.uint32)
    return codes.tobytes().decode("utf-32-le", "surrogatepass"), at[kept]


def map_text(text: str | None, cfg: NormalizerConfig = NormalizerConfig()) -> tuple[str, list[int]]:
    """places() with a plain list."""
    norm, at = places(text, cfg)
    return norm, at.tolist()


def normalize_with_mapping(cfg: NormalizerConfig = NormalizerConfig()) -> Callable[[Column], Column]:
    """A pandas UDF that returns struct<text, map>; null counts as ''."""

    @F.pandas_udf(MAPPED)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [map_text(t, cfg) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "map": [r[1] for r in rows]})

    return run


def original_span(mapping: Column, start: Column, end: Column) -> Column:
    """The half-open original span of a half-open normalised one; an empty or outlying one is an error."""
    bad = (start < 0) | (end > F.size(mapping)) | (start >= end)
    span = F.struct(F.get(mapping, start).alias("start"), (F.get(mapping, end - 1) + 1).alias("end"))
    return F.when(bad, F.raise_error(F.lit("the normalised span is empty or outside the text")).cast("struct<start:int,end:int>")).otherwise(span)
