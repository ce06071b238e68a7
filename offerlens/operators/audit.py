"""Audits of records and labels: fill, methods, conflicts, completeness, sheets, gold labels and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def base_metrics(cells: DataFrame, fields: int) -> DataFrame:
    """One row over cells (doc, field, value, confidence, method): records, cells, filled, by method, and mean confidence of the filled."""
    filled = F.col("value").isNotNull()
    by = lambda m: F.count_if(filled & (F.col("method") == m)).alias(f"n_{m}")
    got = cells.agg(F.countDistinct("doc").alias("records"), F.count_if(filled).alias("filled"), by("rule"), by("model"), by("hybrid"), F.count_if(F.col("method").startswith("conflict")).alias("conflicts"), F.avg(F.when(filled, F.col("confidence"))).alias("confidence"))
    return got.withColumn("cells", F.col("records") * fields).withColumn("fill_rate", F.when(F.col("cells") > 0, F.col("filled") / F.col("cells")))


def record_quality(cells: DataFrame, fields: int) -> DataFrame:
    """doc, fill (share of the fields that have a value) and confidence (mean over those, 0 without any)."""
    filled = F.col("value").isNotNull()
    return cells.groupBy("doc").agg((F.count_if(filled) / F.lit(fields)).alias("fill"), F.coalesce(F.avg(F.when(filled, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def completeness(records: DataFrame, kind: str, fields: list[str], ceiling: float = 0.35) -> DataFrame:
    """(finding, n, threshold, flagged): records without any field, and records without a kind, flagged above the ceiling's share."""
    empty = F.forall(F.array(*[F.col(f).isNull() for f in fields]), lambda x: x)
    got = records.agg(F.count(F.lit(1)).alias("total"), F.count_if(empty).alias("empty_record"), F.count_if(F.col(kind).isNull()).alias("no_kind"))
    rows = got.select("total", F.inline(F.array(F.struct(F.lit("empty_record").alias("finding"), F.col("empty_record").alias("n"), F.lit(0).cast("long").alias("threshold")), F.struct(F.lit("no_kind").alias("finding"), F.col("no_kind").alias("n"), F.floor(F.col("total") * ceiling).alias("threshold")))))
    return rows.select("finding", "n", "threshold", (F.col("n") > F.col("threshold")).alias("flagged"))


def violations(row: dict[str, tuple[Column, str]]) -> Column:
    """An array of (field, problem) structs: for each field a condition that must hold, null passing, and what is wrong if it does not."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.struct(F.lit(f).alias("field"), F.lit(problem).alias("problem"))) for f, (ok, problem) in row.items()]))


def repaired(value: Column, legal: list[str], synonyms: dict[str, str]) -> Column:
    """The legal value that an entry stands for: itself, a synonym, a legal value it begins, or one it is part of; else null."""
    key = F.lower(F.trim(value))
    first = lambda test: F.coalesce(*[F.when((F.length(key) > 2) & test(F.lit(v)), F.lit(v)) for v in legal])
    return F.coalesce(F.when(key.isin(legal), key), *[F.when(key == k, F.lit(v)) for k, v in synonyms.items()], first(lambda v: F.startswith(v, key)), first(lambda v: F.contains(v, key)))


def gold_audit(gold: DataFrame, records: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(id, field, problem): gold labels of unknown records, and those that break a check."""
    unknown = gold.join(records.select("id"), "id", "left_anti").select("id", F.lit("id").alias("field"), F.lit("unknown").alias("problem"))
    return unknown.unionByName(gold.select("id", F.inline(violations(checks))))


def blank_but_found(gold: DataFrame, cells: DataFrame, least: float) -> DataFrame:
    """(id, field, value): fields that a person left empty and the system filled with confidence of at least so much."""
    empty = gold.where(F.col("value").isNull()).select("id", "field")
    return cells.where((F.col("value").isNotNull()) & (F.col("confidence") >= least)).join(empty, ["id", "field"], "left_semi").select("id", "field", "value")


def placed(records: DataFrame) -> DataFrame:
    """(id, place): where each record stands by order of id, from 0; counted by range partitions, so no task orders all records."""
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.select("id").repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    own = dealt.withColumn("_n", F.row_number().over(W.partitionBy("part").orderBy("id")))
    size = own.groupBy("part").agg(F.max("_n").alias("size"))  # a row a partition
    before = size.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(before.select("part", "before")), "part").select("id", (F.col("before") + F.col("_n") - 1).alias("place"))


def sheet_split(records: DataFrame, shared: int, people: int) -> DataFrame:
    """(id, block): the first `shared` records by order go to all, block -1; the rest are dealt to the people in turn."""
    at = F.col("place")
    return placed(records).select("id", F.when(at < shared, -1).otherwise(F.pmod(at - shared, F.lit(people))).cast("int").alias("block"))


def corpus_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rows, digest): the same for equal sets of rows in any order; an index with another digest is stale.

    Each row's digest is read as two numbers that are summed, so the aggregate combines before the shuffle.
    """
    h = F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))), 256)
    number = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(20,0)")
    return docs.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[F.sum(number(a)).cast("decimal(38,0)").cast("string") for a in (1, 16)]).alias("digest"))


def greedy_cover(candidates: DataFrame, quota: int, rounds: int) -> DataFrame:
    """(round, id): a sample that opens as many fields as it can.

    candidates has id, bank and fields (array).  A field is open until `quota` chosen records have it.  Each round takes
    the record with most open fields, of those one of the least used bank, then the smallest id.  The state, counts of
    fields and banks and the chosen ids, is bounded by the number of rounds; each round is one aggregate over all.
    """
    spark, chosen, have, used = candidates.sparkSession, [], {}, {}
    names = sorted(r[0] for r in candidates.select(F.explode("fields").alias("f")).distinct().collect())
    for n in range(rounds):
        open_ = F.array(*[F.lit(f) for f in names if have.get(f, 0) < quota]).cast("array<string>")
        times = F.coalesce(*[F.when(F.col("bank") == b, F.lit(k)) for b, k in used.items()], F.lit(0))
        rest = candidates.where(~F.col("id").isin([i for _, i in chosen])) if chosen else candidates
        scored = rest.withColumn("gain", F.size(F.array_intersect("fields", open_)))
        best = scored.agg(F.min_by(F.struct("id", "bank", "fields", "gain"), F.struct(-F.col("gain"), times, F.col("id"))).alias("r")).first()["r"]
        if best is None or best["gain"] == 0:
            break
        chosen.append((n, best["id"]))
        used[best["bank"]] = used.get(best["bank"], 0) + 1
        for f in set(best["fields"]):
            have[f] = have.get(f, 0) + 1
    return spark.createDataFrame(chosen, "round int, id string")
