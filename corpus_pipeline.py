"""A corpus pipeline of five stages over `documents`, each on all that its predecessor kept.

Language identification drops the documents it rejects, exact dedup and near-dedup keep one document of each group,
suffix-array dedup takes repeated passages out of the texts, and packing deals the documents into batches.  Null texts
have no language and are dropped by the first stage, as are texts without a letter.  Dedup decides by doc_id, which the
table holds once; rows that repeat one keep or lose their place together.  Extra columns, of any names, are carried
along; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import exact, language, minhash, packing, repeats
from offerlens.llm.shared import shared_folder


def free(docs: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def kept_only(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is kept."""
    own = free(docs, "kept_id")
    ids = decided.where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids[own]), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is one of those learned from the labelled ones.

    Null texts, texts without a letter and texts unlike any language go; without labelled documents all go.  Repeated
    rows are judged alike, very long texts whole.
    """
    return language.accepted(docs, language.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text, the one of largest doc_id.  Null texts count as empty; a null id stays only if no other has its text."""
    index = exact.DigestIndex(spark, "pipeline_digest_index_" + re.sub(r"\W", "_", spark.sparkContext.applicationId))
    index.drop()
    return kept_only(docs, exact.dedup(docs, index))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of least doc_id.  Texts without words and null ids stay."""
    return kept_only(docs, minhash.near_duplicates(docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of any 100-byte string that starts earlier; n_chars, if there, follows the text.

    Null texts become empty.  Rows are told apart by a number that each evaluation of docs gives anew, so docs must be
    a read of files or another plan that deals its rows alike each time; repeated and null ids are no matter.
    """
    key, cut_key, cut_text = free(docs, "row_key"), free(docs, "cut_key"), free(docs, "cut_text")
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    cut = repeats.without_repeated_bytes(rows, with_text=True, key_col=key).select(F.col("row_key").alias(cut_key), F.col("kept").alias(cut_text))
    joined = rows.drop("text").join(cut, F.col(key) == F.col(cut_key)).withColumnRenamed(cut_text, "text")
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with its length in words, bucket, batch and slot.  Null and empty texts have length 0."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: The stages are a classifier, a banded similarity join and passage removal: SQL has no form for their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet in the shared checkpoint folder and read again.

    A stage's folder is removed once the next one is written; the last stays, as the result reads from it.
    """
    at, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{name}"
    return docs
