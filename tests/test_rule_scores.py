"""Rules scored against labels: records and labels meet by document, in rows of whole documents."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from offerlens.operators import evaluation

SMALL = "/root/testdata/sf0.001"
GOLD = "doc string, field string, kind string, expected string"


def test_labels_by_record_equal_labels_by_cell(spark):
    texts = ["Aylık kâr payı oranı %2,05\nKampanya 31.12.2026 tarihine kadar", "kâr payı oranı %45", "12 taksit vade, %1,5 kar payı oranı", None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "%1,2 kar payı oranı")], "doc_id int, text string")
    gold = spark.createDataFrame(
        [(str(d), f, k, e) for d in range(5) for f, k, e in (("rate", "number", "2.06"), ("rate", "number", "1.2"), ("rate", "text", "2.05"), ("ends_on", "day", "31.12.2026"), ("ends_on", "text", "2026-12-31"), ("term_months", "number", None), ("unknown", "number", "1"))],
        GOLD,
    )
    nested = gold.groupBy("doc").agg(F.collect_list(F.struct("field", "kind", "expected")).alias("labels"))
    found = spark.createDataFrame([("0", "rate", "2.05"), ("0", "ends_on", "2026-12-31"), ("2", "rate", "1.2"), ("2", "term_months", "12.0")], "doc string, field string, found string")
    want = {tuple(r) for r in evaluation.scored(gold, found, spark.sql("SELECT CAST(id AS STRING) AS doc FROM range(3)")).collect()}
    assert {tuple(r) for r in evaluation.rules_scored(gold, docs).collect()} == want
    assert {tuple(r) for r in evaluation.rules_scored(nested, docs).collect()} == want


def test_no_cell_is_shuffled_on_its_own(spark):
    plan = queries()["rule_scores"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    joins = [i for i, x in enumerate(lines) if "Join " in x]
    assert len(joins) == 1 and all(i < joins[0] for i, x in enumerate(lines) if "Generate " in x or "inline" in x)
