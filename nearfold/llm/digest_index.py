"""Exact deduplication against a persistent index of SHA-256 digests, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import attach, key_of, row_key, table
from nearfold.scratch import discard, new_path, written


class DigestIndex:
    """Digests of all texts seen so far, in an external table clustered and sorted by digest.

    A new batch is reduced to one row per digest, anti-joined to the index by sort-merge and appended; both sides are
    partitioned by digest into the same buckets, so the index itself is never shuffled. Every batch adds a sorted file to a bucket; Spark
    sorts a bucket of several files once more before it merges, within its task. Opening the same path again
    continues it, in another session as well. A batch that is repeated under its name, for example after a lost
    driver, gives the same result and appends nothing.

    Contract: texts are equal if their UTF-8 bytes are; null counts as empty. Of equal texts of one batch the row with
    the largest doc_id stays; a text that an earlier batch brought loses to it. Rows with one text and one doc_id are
    repeats of which a single row stays; null ids come last. Other columns are ignored, whatever their names.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or new_path(spark, "digests")
        self.buckets = self._buckets(buckets)
        self.name = "nearfold_digests_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )

    def _buckets(self, asked: int | None) -> int:
        """The number of buckets, which is fixed when the index is made and kept beside it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return int(self.spark.read.text(f"{self.path}/buckets").first()[0])
        n = asked or max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.spark.range(1).select(F.lit(str(n)).alias("value")).coalesce(1).write.text(f"{self.path}/buckets")
        return n

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self, delete: bool = False) -> None:
        """Takes the table out of the session's catalog, and deletes the index if asked to. What deduplicate returned stays valid, as it reads tables of its own."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            discard(self.spark, self.path)

    def deduplicate(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of docs: id, keep_id, group_size, kept, text_sha256. Appends what is new to the index."""
        staged = written(
            docs.select(
                F.col(id_col).cast("bigint").alias("id"),
                F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
            ).withColumn("row", F.monotonically_increasing_id()),
            "staged",
        )
        groups = written(
            staged.groupBy("digest").agg(
                F.max("id").alias("top_id"), F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("n")
            ).repartition(self.buckets, "digest"),
            "groups",
        )
        fresh = groups.repartition(self.buckets, "digest").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", F.col("top_id").alias("keep_id"), F.lit(batch).alias("batch"))
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", f"{self.path}/data").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        decided = written(
            groups.join(self.table().select("digest", "keep_id", "batch").hint("merge"), "digest").select(
                "digest", "keep_id", "n", F.when(F.col("batch") == batch, F.col("top.row")).alias("keep_row")
            ),
            "decided",
        )
        return attach(staged, decided, ["digest"], "n").select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("n").alias("group_size"),
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` against a new index."""
    index = DigestIndex(spark)
    found = index.deduplicate(table(spark, sf_dir, "documents"), "all")
    index.close(delete=True)
    return found


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay: of equal texts the row with the largest id, null ids last.

    Null text counts as empty. Rows that repeat both doc_id and text count as one document, of which one row stays; columns may have any names.
    """
    index = DigestIndex(spark)
    seen = index.deduplicate(docs, "stage")
    index.close(delete=True)
    # one key for the join and for repeats, so that the texts are shuffled once: SHA-256 of id and text's digest
    stay = seen.filter("kept").select(key_of(F.col("doc_id"), F.col("text_sha256")).alias("chosen"))
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return packed.hint("merge").join(stay, F.col("key") == F.col("chosen"), "left_semi").dropDuplicates(["key"]).select("row.*")
