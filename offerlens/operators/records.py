"""Records with evidence: upsert, survivors of duplicates, candidate ownership and choice, reconciliation, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.functions.text import near


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of largest seq of each key: what an upsert leaves."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(key, "_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new by key, new rows first.  Write it elsewhere than old is read from."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def survivors(rows: DataFrame, signature: str, order: list[Column]) -> DataFrame:
    """keep_id for each row: the id that comes first in its group of equal signatures.  The order must be total and end in id."""
    first = rows.groupBy(signature).agg(F.min_by("id", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(first, signature)


def owners(candidates: DataFrame, apart: Column | None = None) -> DataFrame:
    """Of the fields that claim one span, the nearest owns it, then the first rule.  Columns doc, start, end, field, distance, rule.

    apart: a value for the rows that compete among themselves only, null for the others.
    """
    keys = ["doc", "start", "end"] + ([] if apart is None else [apart])
    w = W.partitionBy(*keys).orderBy("distance", "rule")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: How much less confident than the best a candidate may be that is chosen for its value.
BAND = 0.15


def chosen(candidates: DataFrame, band: float = BAND) -> DataFrame:
    """One candidate for each doc and field by its mode: first, nearest (most confident), highest or lowest.

    highest and lowest choose among those within `band` of the greatest confidence; equal values fall to the more
    confident, then to the earlier.
    """
    g = W.partitionBy("doc", "field")
    kept = candidates.withColumn("_top", F.max("confidence").over(g)).where(~F.col("mode").isin("highest", "lowest") | (F.col("confidence") >= F.col("_top") - band))
    key = F.when(F.col("mode") == "highest", -F.col("value")).when(F.col("mode") == "lowest", F.col("value")).when(F.col("mode") == "nearest", -F.col("confidence")).otherwise(F.col("start").cast("double"))
    order = g.orderBy(key, F.col("confidence").desc(), "start")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_top")


def reconciled(rules: DataFrame, model: DataFrame, numeric: list[str]) -> DataFrame:
    """One cell for each doc and field from a rule layer and a model layer (doc, field, value, confidence).

    Alone, a layer's cell stands.  If both agree up to 1 %, the value is hybrid with the larger confidence and 0.08
    more, at most 1.  If they differ, rules win numeric fields and the model the others, with 0.25 less confidence.
    """
    r = rules.select("doc", "field", F.col("value").alias("rv"), F.col("confidence").alias("rc"))
    m = model.select("doc", "field", F.col("value").alias("mv"), F.col("confidence").alias("mc"))
    rows = r.join(m, ["doc", "field"], "full")
    same, rule_wins = near(F.col("rv"), F.col("mv")), F.col("field").isin(numeric)
    both = F.col("rv").isNotNull() & F.col("mv").isNotNull()
    return rows.select(
        "doc", "field",
        F.when(~both, F.coalesce("rv", "mv")).when(same | rule_wins, F.col("rv")).otherwise(F.col("mv")).alias("value"),
        F.when(~both, F.coalesce("rc", "mc")).when(same, F.least(F.lit(1.0), F.greatest("rc", "mc") + 0.08)).otherwise(F.greatest(F.lit(0.0), F.when(rule_wins, F.col("rc")).otherwise(F.col("mc")) - 0.25)).alias("confidence"),
        F.when(F.col("mv").isNull(), "rule").when(F.col("rv").isNull(), "model").when(same, "hybrid").when(rule_wins, "conflict_rule").otherwise("conflict_model").alias("method"),
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of slot filling for each field: a wrong value is both a false positive and a false negative.

    pairs has field, gold and predicted of labelled cells; null is "empty".  precision, recall and f1 are null if there
    was nothing to find or say.
    """
    g, p = F.col("gold"), F.col("predicted")
    same = g.eqNullSafe(p)
    n = pairs.groupBy("field").agg(
        F.count_if(g.isNotNull() & same).alias("tp"), F.count_if(p.isNotNull() & ~same).alias("fp"), F.count_if(g.isNotNull() & ~same).alias("fn"), F.count_if(same).alias("right"), F.count(F.lit(1)).alias("n"),
    )
    ratio = lambda a, b: F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.when(b > 0, a / b).otherwise(0.0))
    tp = F.col("tp")
    return n.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def majority(labels: DataFrame) -> DataFrame:
    """(id, field, value) of the values that more than half of a cell's annotators chose."""
    votes = labels.groupBy("id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = labels.groupBy("id", "field").agg(F.count(F.lit(1)).alias("total"))
    return votes.join(total, ["id", "field"]).where("n * 2 > total").select("id", "field", "value", "n", "total")


def agreement(labels: DataFrame) -> DataFrame:
    """Pairwise agreement for each field over annotators a < b of the same record; the non-empty one leaves out cells both left empty."""
    a, b = labels.select("id", "field", F.col("who").alias("a"), F.col("value").alias("x")), labels.select("id", "field", F.col("who").alias("b"), F.col("value").alias("y"))
    pairs = a.join(b, ["id", "field"]).where("a < b")
    same, filled = F.col("x").eqNullSafe(F.col("y")), F.col("x").isNotNull() | F.col("y").isNotNull()
    return pairs.groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"), F.count_if(filled).alias("filled"), F.count_if(same & filled).alias("same_filled"))


def copied(labels: DataFrame, least: int = 10) -> DataFrame:
    """Annotator pairs that agree on every one of at least so many cells that either filled."""
    pairs = agreement(labels).groupBy("a", "b").agg(F.sum("filled").alias("filled"), F.sum("same_filled").alias("same_filled"))
    return pairs.where((F.col("filled") >= least) & (F.col("filled") == F.col("same_filled")))
