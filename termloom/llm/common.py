"""Shared helpers: tables, shared-folder staging, Arrow batches, let-bindings for SQL arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources.staging import passing, release, shared_dir, staged, unstage

__all__ = ["SPACES", "WORD_GAP", "held_out", "labelled_sample", "let", "passing", "release", "repeated", "running", "shared_dir", "slices", "staged", "table", "unstage"]

#: What separates words in every contract of this subpackage: space and the ASCII controls 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repeated(df: DataFrame, times: str, index: str, chunk: int = 4096) -> DataFrame:
    """Each row `times` (a column, which goes) times, with a 0-based column index. Rows asked for more than chunk times are dealt out between, so
    that no task makes more than chunk rows of one."""
    n, part = F.col(times), f"{index}_part"
    parts = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk))))
    few, many = parts.where(n <= chunk), parts.where(n > chunk)
    each = few.unionByName(many.repartition(F.col(part), F.rand(1)))
    own = F.sequence(F.col(part) * chunk, F.least(n, (F.col(part) + 1) * chunk) - 1)
    return each.withColumn(index, F.explode(own)).drop(times, part)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, even if body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id counts as text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Row ranges of a string column with about max_bytes of text each; one longer text is a range of its own."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) if len(column) else np.zeros(0, np.int64)
    start, base = 0, 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield start, column.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and 0/1 labels to fit a classifier on, and the share of label 1 (smoothed) among all labels seen.

    At most rows / 2 labelled documents of either class, of at most max_chars characters each. Only labels outside the
    fold held_out() are seen; null labels and texts are passed over; of several labels of a doc_id the smallest
    counts. The first in the order of a hash of doc_id are taken, so reruns agree.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = known.where("label = 0").orderBy("place", "doc_id").limit(rows).unionByName(known.where("label = 1").orderBy("place", "doc_id").limit(rows))
    # at most 2 * rows rows of three numbers
    found = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(some), "doc_id")
    parts = [found.where(F.col("label") == c).orderBy("place", "doc_id", "text").limit(rows // 2).select("text", "label") for c in (0, 1)]
    got = parts[0].unionByName(parts[1]).toArrow()
    return got.column("text").to_pylist(), got.column("label").to_numpy().astype(np.float64), (n.get(1, 0) + 1) / (sum(n.values()) + 2)


def running(values: Column, add: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For each element of an int array what add (associative, from 0) makes of those before it; in two levels, so that no long array is
    copied for each element."""
    ints = "array<int>"
    step = lambda acc, x: F.struct(add(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    scan = lambda xs, start: F.aggregate(xs, F.struct(start.cast("int").alias("at"), F.array().cast(ints).alias("out")), step, lambda acc: acc["out"])

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
        inner = lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda a, y: add(a, y).cast("int"))), F.lit(0)), scan))
        return let(blocks, inner)

    return F.when(F.size(values) == 0, F.array().cast(ints)).otherwise(let(values, of))
