"""Sources and sinks: page snapshots, seeds, label sheets, gold labels, exports, state tables.

Schemas are explicit; nothing is inferred.  Paths may be any that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.text import campaign_id
from offerlens.operators.records import upsert

PAGE = "bank string, bank_name string, url string, fetched_at timestamp_ntz, http_status int, title string, raw_html string, body string"
CELL = "value string, raw string, unit string, confidence double, method string, quote string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots, one JSON document a file, in folders of any depth."""
    rows = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("campaign_id", campaign_id(F.col("bank"), F.col("url")))


def write_pages(pages: DataFrame, path: str) -> None:
    """A folder of JSON lines for each bank."""
    pages.write.mode("append").partitionBy("bank").json(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(stem, html) of the html files that lie beside snapshots."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("stem"), F.col("value").alias("html"))


def unseen(html: DataFrame, stems: DataFrame) -> DataFrame:
    """Html files without a snapshot of the same stem."""
    return html.join(stems.select("stem"), "stem", "left_anti")


def read_seed(spark: SparkSession, path: str, fetched_at: str) -> DataFrame:
    """Seed lines {bank, bank_name, id, text}: pages with a made-up url and the given time."""
    rows = spark.read.schema("bank string, bank_name string, id string, text string").json(path)
    return rows.select("bank", "bank_name", F.concat(F.lit("seed://"), "bank", F.lit("/"), "id").alias("url"), F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"), F.col("text").alias("body"))


def read_gold(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Gold labels in JSON lines; blank lines and // comments are skipped.

    labelled lists the keys that a line has: an absent key is not labelled, a null one is labelled empty.
    """
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT ltrim(value) LIKE '//%'")
    return lines.select(F.from_json("value", fields).alias("r"), F.json_object_keys("value").alias("labelled")).select("r.*", "labelled")


def read_sheet(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A label sheet with a header, tall: (id, field, state, value); blank is empty, ? abstains, untouched rows are left out."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, first.lstrip("﻿"))
    touched = F.greatest(*[(F.trim(F.coalesce(f, F.lit(""))) != "").cast("int") for f in fields], F.lit(0)) == 1
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(f, F.lit(""))).alias("v")) for f in fields])
    v = F.col("v")
    return rows.where(touched).select("id", F.inline(cells)).select("id", "field", F.when(v == "?", "abstain").when(v == "", "empty").otherwise("value").alias("state"), F.when((v != "") & (v != "?"), v).alias("value"))


def save_by_key(spark: SparkSession, rows: DataFrame, path: str, key: str) -> str:
    """Upsert rows into a table of versions under path; returns the folder of the new version.

    Each version is a folder of its own, so a failed write never harms what readers have.
    """
    versions = sorted(read_versions(spark, path))
    old = spark.read.parquet(f"{path}/v{versions[-1]:08d}") if versions else None
    to = f"{path}/v{(versions[-1] + 1 if versions else 0):08d}"
    (rows if old is None else upsert(old, rows, key)).write.parquet(to)
    return to


def read_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions under path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return [int(n[1:]) for n in done]


def append_run(spark: SparkSession, path: str, config: str, rows: int, fingerprint: str, at: str) -> None:
    """One row in the run log."""
    spark.createDataFrame([(at, config, rows, fingerprint)], "at string, config string, rows long, fingerprint string").withColumn("at", F.col("at").cast("timestamp_ntz")).write.mode("append").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.max_by(F.struct("at", "config", "rows", "fingerprint"), "at").alias("r")).select("r.*")


def export_csv(records: DataFrame, fields: list[str], path: str) -> None:
    """Identity columns, then value, method and confidence of each cell; semicolons."""
    own = [c for c in records.columns if c not in fields]
    cells = [x for f in fields for x in (F.col(f"{f}.value").alias(f), F.col(f"{f}.method").alias(f"{f}__method"), F.round(f"{f}.confidence", 3).alias(f"{f}__confidence"))]
    records.select(*own, *cells).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def export_jsonl(records: DataFrame, fields: list[str], path: str, quote_chars: int = 300) -> None:
    """Identity columns and a map of the cells that have a value, quotes cut short."""
    own = [c for c in records.columns if c not in fields]
    short = lambda f: F.struct(*[(F.substring(f"{f}.quote", 1, quote_chars) if c == "quote" else F.col(f"{f}.{c}")).alias(c) for c in ("value", "raw", "unit", "confidence", "method", "quote")])
    cells = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[short(f) for f in fields]))
    records.select(*own, F.map_filter(cells, lambda k, v: v["value"].isNotNull()).alias("fields")).write.mode("overwrite").json(path)
