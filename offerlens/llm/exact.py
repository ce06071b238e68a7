"""Exact dedup against a persistent digest index (operator 9, DataFrame functions only).

The index is a table bucketed and sorted by digest.  A batch is reduced to one row per digest, kept out of the index
by a sort-merge anti-join if known, and appended; the index side of that join needs neither shuffle nor sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group at least this share of the batch is hot; there can be no more than 1 / HOT_SHARE such groups.
HOT_SHARE = 1 / 1000


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256)


class DigestIndex:
    """digest -> keep_id and group_size of the batch that brought it, in a table of the session's catalog."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def create(self) -> None:
        """Make the table, empty, unless it is there."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def append(self, digests: DataFrame) -> None:
        """Add the digests that are new; digests has digest and the long row_id.  Of equal ones the largest id counts."""
        self.create()
        # the join is on an aggregate, or it would be pushed below the aggregation, to all rows of a hot group in one task
        new = digests.groupBy("digest").agg(F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("digest").alias("own"))
        known = self.read().select(F.col("digest").alias("known")).hint("merge")
        new = new.join(known, F.col("own") == F.col("known"), "left_anti").drop("own")
        new.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts in a batch the largest id stays, unless an
    earlier batch brought the text to the index: then none of the new ones stays and keep_id is the earlier id.
    Two rows with the same id and text both count in group_size, and both are kept if that id stays.  A null id stays
    only if its text has no other.  An empty table gives no rows and leaves the index as it is (empty, if new).
    Without an index, a new one is made.  Only the two columns are read.
    """
    index = index or DigestIndex(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), digest(F.col(text_col)).alias("digest"))
    index.append(rows)
    known = index.read().select("digest", "keep_id", "group_size")
    # Groups that many rows share are few, whatever the input: those are looked up in memory, the rest by sort-merge.
    least = max(1000, int(known.agg(F.sum("group_size")).first()[0] or 0) * HOT_SHARE)
    hot = known.where(F.col("group_size") >= least)
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known.hint("merge"), "digest")
    found = rows.join(F.broadcast(hot), "digest").unionByName(rest)
    return found.select(
        F.col("row_id").alias("doc_id"), "keep_id", "group_size",
        F.coalesce(F.col("row_id") == F.col("keep_id"), F.col("row_id").isNull() & F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256"),
    )
