"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.operators.joins import attach  # noqa: F401

#: Words are maximal runs of characters other than these six.
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text, null counting as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), "")


def key_of(doc_id: Column, digest: Column) -> Column:
    """SHA-256 of a row's id and its text's digest in hex; a null id counts as itself."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest), 256))


def row_key(doc_id: Column, text: Column) -> Column:
    """key_of a row; null text counts as empty."""
    return key_of(doc_id, F.sha2(F.coalesce(text, F.lit("")), 256))


def rows_of(docs: DataFrame, keys: DataFrame, key: Column, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose row_key is in `keys` (column _key), or with how="left_anti" is not. Columns of docs may have any names."""
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), key.alias("key"))
    return packed.join(keys.select(F.col("_key").alias("chosen")).hint("merge"), F.col("key") == F.col("chosen"), how).select("row.*")


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column holds about `most` bytes; a longer row comes alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n, start = len(col), 0
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        have = 0
        for i, size in enumerate(sizes):
            if i > start and have + size > most:
                yield batch.slice(start, i - start)
                start, have = i, 0
            have += size
        yield batch.slice(start, n - start)


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows, those of the smallest hashes of their key: the same ones however the table is partitioned.

    A first cut by hash leaves about twice as many, so that what is sorted doesn't grow with the table.
    """
    n = rows.count()
    if n > 4 * most:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) <= int((1 << 20) * 2 * most / n) + 1)
    return rows.orderBy(F.xxhash64(key), key).limit(most)
