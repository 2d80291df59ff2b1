"""Knowledge-base tables and vector indexes on storage: Parquet or JSON lines."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.schemas import TABLES


@dataclass
class KnowledgeBase:
    concepts: DataFrame
    aliases: DataFrame
    drug_products: DataFrame
    drug_brands: DataFrame
    issues: DataFrame
    report: DataFrame

    def register(self, prefix: str = "kb_") -> None:
        """Make the tables known to SQL as temporary views."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)


def write_kb(kb: KnowledgeBase, folder: str, fmt: str = "parquet") -> None:
    """One folder a table, sorted by its ids. JSON lines leave nulls out."""
    keys = {"concepts": ["concept_id"], "aliases": ["alias_normalized", "target_id"], "drug_products": ["product_id"], "drug_brands": ["brand_id"]}
    for name in TABLES:
        table = getattr(kb, name)
        (table.orderBy(*keys[name]) if name in keys else table).write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def read_kb(spark: SparkSession, folder: str, fmt: str = "parquet") -> KnowledgeBase:
    """Tables with their fixed schemas; malformed rows end the job. Of rows that repeat an id the last one counts."""
    tables = {name: spark.read.schema(schema).option("mode", "FAILFAST").format(fmt).load(f"{folder}/{name}") if fmt == "json" else spark.read.schema(schema).format(fmt).load(f"{folder}/{name}") for name, schema in TABLES.items()}
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    for name, key in (("concepts", "concept_id"), ("drug_products", "product_id"), ("drug_brands", "brand_id")):
        tables[name] = unique(tables[name], key, place)
    return KnowledgeBase(**tables)


def unique(df: DataFrame, key: str, place: Column | None = None) -> DataFrame:
    """One row for each key: the last, by `place` (where its rows were read) if given, then in the order of reading."""
    after = F.struct(*([place] if place is not None else []), F.monotonically_increasing_id())
    numbered = df.select("*", after.alias("read_after"))
    return numbered.groupBy(key).agg(F.max_by(F.struct(*df.columns), "read_after").alias("row")).select("row.*")


def write_report(report: DataFrame, path: str) -> None:
    """The one-row report as indented JSON, on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report.first().asDict(), f, indent=2, ensure_ascii=False)


def write_vectors(index: DataFrame, folder: str, model_name: str) -> None:
    """Vectors with payload, and one row that tells model, count and dimension."""
    index.write.mode("overwrite").parquet(f"{folder}/vectors")
    about = index.agg(F.count(F.lit(1)).alias("count"), F.max(F.size("vector")).alias("dim")).select(F.lit(model_name).alias("model_name"), "count", "dim")
    about.write.mode("overwrite").parquet(f"{folder}/about")


def read_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/about").first().asDict()
