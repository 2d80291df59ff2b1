"""Raw inputs: the synonym list (JSON array) and the drug list (CSV), read with fixed schemas and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.schemas import ENTITY_TYPES, SYNONYMS

# The headers under which a drug list may carry each field, best first, and pandas' words for "missing".
DRUG_COLUMNS = {
    "drug_code": ("drug_code", "aic", "AIC"),
    "drug_name": ("drug_name", "name", "denominazione"),
    "atc": ("atc", "atc_code", "ATC"),
    "drug_form": ("drug_form", "drug_form_full_descr", "form", "forma"),
    "compositions": ("composition", "compositions", "composizione"),
    "excipients": ("excipients", "eccipienti"),
}
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def first_available(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that isn't blank, trimmed; null if none is. Names that df lacks are passed over."""
    there = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def split_hash_list(value: Column) -> Column:
    """The parts of a '#'-separated list, trimmed, without blank ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "#"), lambda x: F.trim(x)), lambda x: x != "")


def clean_list(values: Column) -> Column:
    """A list without null and blank items, the rest trimmed; null gives an empty list."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def required(value: Column, what: str, where: Column) -> Column:
    """The trimmed value; a blank one ends the job with the row's name."""
    v = F.nullif(F.trim(value), F.lit(""))
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"{what} is blank in row "), where.cast("string"))).cast("string")).otherwise(v)


def optional(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def violations(df: DataFrame, needed: tuple[str, ...], row: str = "seq") -> DataFrame:
    """(row, field) of every blank among the needed columns: the report form of required()."""
    bad = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in needed))))
    return df.select(F.col(row), bad.alias("field"))


def clean_synonyms(rows: DataFrame) -> DataFrame:
    """Rows (seq, SYNONYMS columns) checked: seq, ingredient_it, ingredient_en, entity_type, synonyms_it, synonyms_en."""
    kind = F.trim("type")
    unknown = F.raise_error(F.concat(F.lit("unknown entity type in row "), F.col("seq").cast("string"))).cast("string")
    return rows.select(
        "seq", required(F.col("ingredient_it"), "ingredient_it", F.col("seq")).alias("ingredient_it"), optional(F.col("ingredient_en")).alias("ingredient_en"),
        F.when(kind.isin(*ENTITY_TYPES), kind).otherwise(unknown).alias("entity_type"), clean_list(F.col("synonyms_it")).alias("synonyms_it"), clean_list(F.col("synonyms_en")).alias("synonyms_en"),
    )


def clean_drugs(rows: DataFrame) -> DataFrame:
    """Rows with seq and any of the known headers as strings: seq and the DRUGS columns, checked."""
    get = lambda k: first_available(rows, DRUG_COLUMNS[k])
    return rows.select(
        "seq", required(get("drug_code"), "drug_code", F.col("seq")).alias("drug_code"), required(get("drug_name"), "drug_name", F.col("seq")).alias("drug_name"),
        get("atc").alias("atc"), get("drug_form").alias("drug_form"), split_hash_list(get("compositions")).alias("compositions"), split_hash_list(get("excipients")).alias("excipients"),
    )


def numbered(df: DataFrame) -> DataFrame:
    """df with seq, 0-based in the order of the file's rows.

    One raw list is one file, so it is read by one task and monotonically_increasing_id() follows its rows;
    of several files the numbers still grow along them, with gaps.
    """
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """The JSON array at path; malformed input ends the job, fields that the schema lacks are dropped."""
    rows = spark.read.schema(SYNONYMS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return clean_synonyms(numbered(rows))


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    """The CSV at path, every field a string (leading zeros stay), quotes doubled within quotes, missing words null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    return clean_drugs(numbered(rows.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in rows.columns))))
