"""Topic words summed inside the tasks that read them: the same words as the Columns make, few rows handed on."""

from collections import Counter
from random import Random

from pyspark.sql import functions as F

from offerlens.operators import topics

ODD = ["", "1234 12345a 1a2b ab12", "İSTANBUL'un Kâr Payı’nda", "abcd\0efgh abċde", "KELVINKelvin", "ΣΑΣ sigma", "mark marka markada markett mar1", "x" * 5000, "𝒶bcd ab cdef", "12345678901234 abcde", "straße ﬁnansman finans", "abcd"]


def texts():
    r = Random(5)
    return ODD + ["".join(r.choices("abcdİıŞ 129'\n-éK", k=r.randint(0, 400))) for _ in range(200)]


def test_words_at_hand_equal_those_of_columns(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string").select("t", topics.words_of(F.col("t")).alias("w")).collect()
    for r in rows:
        assert topics.words_in(r["t"]) == set(r["w"]), r["t"]
    name, stem = topics.stems_in([r["t"] for r in rows])
    got = list(zip(name.tolist(), topics.spelled(stem).to_pylist(), strict=True))
    assert len(got) == len(set(got)) and set(got) == {(i, w[:5]) for i, r in enumerate(rows) for w in r["w"]}
    assert [len(x) for x in topics.stems_in([])] == [0, 0]


def test_spread_of_stems_and_sums_of_words(spark, monkeypatch):
    monkeypatch.setattr(topics, "SUMS_HELD", 10)
    names = texts()
    frame = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(names)], "group int, name string")
    words = [topics.words_in(t) for t in names]
    sums = {(r["group"], r["word"]): r["n"] for r in topics.word_counts(frame).groupBy("group", "word").agg(F.sum("n").alias("n")).collect()}
    assert sums == Counter((i % 3 or None, w) for i, own in enumerate(words) for w in own)
    related = lambda a, b: a[:5] == b[:5] if min(len(a), len(b)) >= 5 else a[:4] == b[:4]
    want = {s: sum(any(related(s, w) for w in own) for own in words) for s in {w[:5] for own in words for w in own}}
    assert {r["stem"]: r["df"] for r in topics.related_counts(frame).collect()} == want


def test_words_are_summed_where_they_are_read(spark):
    rows = spark.sql("SELECT 'a' AS group, CAST(id AS STRING) AS name FROM range(3)")
    plan = topics.topics(rows, spark.sql("SELECT 'x' AS word"))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.count("MapInArrow") == 2
    # below the sums is only what the tasks hand on: no form of a word is looked at there
    assert "yor|digi" not in plan[plan.index("MapInArrow") :].split("Join ")[0]


def test_only_stems_that_topics_begin_like_travel(spark):
    answers = spark.createDataFrame([("a", "akaryakit", 1)], "answer string, topic string, record int")
    plan = topics.on_topic(answers, spark.createDataFrame([(1, "market akaryakıt")], "record int, name string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "regexp_replace" not in plan
