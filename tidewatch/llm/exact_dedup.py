"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row a digest, anti-joined with the
index by sort-merge, and what is new is appended. Only digests travel, never texts.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table, text_or_empty


def digest(column: str = "text"):
    """SHA-256 (hex) of the text with every run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_or_empty(column), "[\\x20\\x09-\\x0D]+", " ").cast("binary"), 256)


class DigestIndex:
    """digest (32 bytes), keep_id: bucketed and sorted by digest in the session's warehouse.

    buckets is fixed for a table's life; choose it so that a bucket of the grown index still sorts in one task.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], "digest binary, keep_id long"))

    def _append(self, new: DataFrame) -> None:
        w = new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        w.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the index away; what ingest returned doesn't need it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Deduplicate docs (doc_id, text) against the index and each other, append what is new.

        One row for each input row: doc_id, keep_id, group_size (equal rows of this batch), kept, text_sha256.
        keep_id is the indexed document if there is one, else the smallest doc_id of the batch's equal texts. Rows
        without doc_id never win over one that has it; repeated rows with the same doc_id and text are all marked
        kept. Texts of any length are hashed whole; an empty batch returns no rows; other columns of docs are left out.
        """
        rows = materialise(docs.select("doc_id", F.unhex(digest()).alias("digest")), "digests")
        groups = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        known = self.table().hint("merge")
        self._append(groups.join(known, "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id")))
        held = materialise(groups.hint("merge").join(self.table(), "digest").select("digest", "keep_id", "group_size"), "held")
        release(groups)
        # held has at most one row a digest, so a hot digest is split by AQE on the side of the rows alone
        out = rows.join(held.hint("merge"), "digest")
        return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


@contextlib.contextmanager
def digest_index(spark: SparkSession):
    """An index for one run, dropped at its end and after a failure."""
    index = DigestIndex(spark)
    try:
        yield index
    finally:
        index.drop()


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with digest_index(spark) as index:
        return index.ingest(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
k AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, k.keep_id, k.group_size, n.doc_id = k.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN k ON n.t = k.t
"""
