"""A stored index of vectors that knows the corpus and the model it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.audit import corpus_fingerprint


def written(vectors: DataFrame, corpus: DataFrame, model: str, at: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the vectors under a folder that holds no index yet, then the corpus's fingerprint and the model's name.

    The note comes last, so a folder without it holds an index whose writing was cut off.
    """
    vectors.write.parquet(f"{at}/vectors")
    corpus_fingerprint(corpus, id_col, text_col).withColumn("model", F.lit(model)).coalesce(1).write.parquet(f"{at}/note")


def opened(spark: SparkSession, at: str, model: str) -> DataFrame:
    """The vectors of an index.  Those of another model can't be compared with this one's and raise an error."""
    made_by = spark.read.parquet(f"{at}/note").first()["model"]
    if made_by != model:
        raise ValueError(f"the index is of model {made_by}, not {model}")
    return spark.read.parquet(f"{at}/vectors")


def stale(spark: SparkSession, at: str, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: whether the corpus is another than the index was made from, and how many rows it has more or less."""
    then, now = spark.read.parquet(f"{at}/note"), corpus_fingerprint(corpus, id_col, text_col)
    both = now.select(F.col("rows").alias("n"), F.col("digest").alias("d"), F.lit(1).alias("one")).join(then.withColumn("one", F.lit(1)), "one")
    return both.select((~F.col("d").eqNullSafe(F.col("digest"))).alias("stale"), (F.col("n") - F.col("rows")).alias("added"))
