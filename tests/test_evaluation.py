"""Typed comparison, scores with unlabelled, empty and missing cells, and the faults of answers, by hand."""

from pyspark.sql import functions as F

from offerlens.operators import evaluation

GOLD = "doc string, field string, kind string, expected string"


def test_kinds_are_compared_as_what_they_are(spark):
    same = [("number", "100", "100.9"), ("number", "0", "0.0"), ("number", "abc", " ABC"), ("day", "2026-03-31", "31.03.2026"), ("day", "31 Mart 2026", "31.3.2026"), ("flag", "true", "1"), ("enum", "Kart ", "kart"), ("enum", "İHTİYAÇ", "ihtiyaç"), ("number", None, None)]
    not_same = [("number", "100", "102"), ("number", "0", "0.001"), ("day", "2026-03-31", "2026-04-01"), ("flag", "true", "false"), ("enum", "kart", "kartlar"), ("number", None, "0"), ("day", "2026-03-31", None), ("enum", "", None)]
    rows = spark.createDataFrame([(*r, True) for r in same] + [(*r, False) for r in not_same], "kind string, a string, b string, want boolean")
    assert [tuple(r) for r in rows.where(evaluation.agrees(F.col("kind"), F.col("a"), F.col("b")) != F.col("want")).collect()] == []
    assert rows.where(evaluation.agrees(F.col("kind"), F.col("a"), F.col("b")).isNull()).count() == 0


def test_absent_is_not_empty(spark):
    gold = spark.createDataFrame([("a", "rate", "number", "2"), ("b", "rate", "number", None), ("c", "rate", "number", None), ("d", "rate", "number", "3"), ("e", "rate", "number", "4"), ("z", "rate", "number", "1"), ("a", "fee", "number", None)], GOLD)
    found = spark.createDataFrame([("a", "rate", "2.01"), ("a", "rate", "9"), ("b", "rate", "5"), ("d", "rate", "4"), ("f", "rate", "1"), ("a", "points", "1"), ("e", "rate", None)], "doc string, field string, found string")
    held = spark.createDataFrame([(c,) for c in "aabcdef"], "doc string")
    got = {r["field"]: r.asDict() for r in evaluation.scored(gold, found, held).collect()}
    assert set(got) == {"rate", "fee"}
    r = got["rate"]
    assert (r["tp"], r["fp"], r["fn"], r["right"], r["skipped"]) == (1, 2, 2, 2, 1) and r["precision"] == r["recall"] == r["f1"] == 1 / 3
    f = got["fee"]
    assert (f["tp"], f["fp"], f["fn"], f["right"]) == (0, 0, 0, 1) and f["f1"] is None
    assert evaluation.macro(evaluation.scored(gold, found, held)).first()["fields"] == 1
    assert evaluation.scored(gold.limit(0), found, held).count() == 0


def test_rules_scored_on_texts(spark):
    docs = spark.createDataFrame([(1, "Konut finansmanı aylık kâr payı oranı %2,05"), (2, None), (3, "")], "doc_id int, text string")
    gold = spark.createDataFrame([("1", "rate", "number", "2.05"), ("2", "rate", "number", "1"), ("3", "rate", "number", "1"), ("1", "ends_on", "day", "2026-01-31")], GOLD)
    got = {r["field"]: (r["tp"], r["fp"], r["fn"], r["skipped"]) for r in evaluation.rules_scored(gold, docs).collect()}
    assert got == {"rate": (1, 0, 1, 1), "ends_on": (0, 0, 1, 0)}


def test_faults_of_answers(spark):
    asked = spark.createDataFrame(
        [
            ("a", "s1", ["list"], True, ["TL"], ["yok"], True), ("b", None, ["list", "term"], False, ["İade", "%5"], ["garanti"], None), ("c", "s1", None, None, None, [], False), ("d", None, ["list"], True, ["x"], None, True), ("e", None, [], True, [None], [None], True),
        ],
        "question string, scenario string, intents array<string>, cited boolean, must array<string>, must_not array<string>, numeric boolean",
    )
    answers = spark.createDataFrame(
        [("a", "list", ["u"], "250 tl", True), ("b", "none", ["u"], "iade GARANTİ", True), ("c", None, None, None, None), ("e", "x", None, "z", False), ("e", "x", ["u"], "a", False), ("q", "x", None, "z", True)],
        "question string, intent string, sources array<string>, said string, cleared boolean",
    )
    judged = evaluation.answers_judged(asked, answers)
    assert {r["question"]: r["faults"] for r in judged.collect()} == {"a": [], "b": ["intent", "source", "missing: %5", "forbidden: garanti"], "c": [], "d": ["unanswered"], "e": ["blocked"]}
    got = {(r["part"], r["name"]): (r["n"], r["passed"]) for r in evaluation.set_scored(judged).collect()}
    assert got == {("all", None): (5, 2), ("cited", None): (3, 2), ("intent", "list"): (1, 1), ("intent", "none"): (1, 0), ("intent", None): (2, 1), ("intent", "x"): (1, 0), ("scenario", "s1"): (2, 2)}
    assert evaluation.set_scored(evaluation.answers_judged(asked.limit(0), answers)).count() == 0
