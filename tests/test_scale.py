"""What the queries hand on at size: work that grows with the input, not with pairs of it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import conditions, eligibility, extraction, gates, questions, retrieval, tables, terms, topics
from offerlens.plans import QUERIES, answers, composed, offers, questions as asked  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, step", [("listing_order", "listed"), ("single_answer", "single_answer")])
def test_offers_are_put_in_order_once(spark, monkeypatch, name, step):
    seen, own = [], getattr(questions, step)
    monkeypatch.setattr(questions, step, lambda c, *a: seen.append(c.count()) or own(c, *a))
    assert QUERIES[name](spark, SMALL).count()
    assert seen == [spark.read.parquet(f"{SMALL}/lineitem.parquet").count()]


def test_condition_answers_order_offers_once(spark, monkeypatch):
    seen, own = [], questions.listed
    monkeypatch.setattr(questions, "listed", lambda c, *a: seen.append(c.count()) or own(c, *a))
    QUERIES["condition_answers"](spark, SMALL).count()
    shown = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert seen == [shown]  # no line lacks both a rate and an amount


def test_outdone_counts_earlier_rows():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, most = rng.integers(0, 120), int(rng.integers(1, 6))
        kind, roof, reach = np.sort(rng.integers(0, 4, n)), rng.choice([1, 2, 3, 5, np.inf], n), rng.choice([1, 2, 3, 4, np.inf], n)
        want = [sum(kind[j] == kind[i] and roof[j] >= roof[i] and reach[j] >= reach[i] for j in range(i)) >= most for i in range(n)]
        assert eligibility.outdone(kind, roof, reach, most).tolist() == want


def test_contenders_hold_the_best_of_every_profile(spark):
    o = offers.conditioned(spark, SMALL.replace("0.001", "0.01")).cache()
    asking = spark.sql("SELECT id AS profile_id, 'FRANCE' AS country, 'HOUSEHOLD' AS customer_type, IF(id % 7 = 0, NULL, id * 2500.0D - 5000) AS amount, CAST(id % 48 + 1 AS INT) AS months FROM range(40)")

    def best(own):
        rows = eligibility.tier(eligibility.reasons(offers.pairs(asking, own)))
        w = Window.partitionBy("profile_id").orderBy("tier", F.when(F.col("tier") == 0, F.round("within", 4)).otherwise(F.col("within")), "offer_id")
        return sorted(map(tuple, rows.withColumn("n", F.row_number().over(w)).where("n <= 5").select("profile_id", "tier", "n", "offer_id").collect()))

    few = eligibility.contenders(o, 5).cache()
    assert best(few) == best(o)
    assert few.count() * 2 < o.count()


def test_pairs_of_an_offer_are_made_at_once_in_bounded_tasks(spark, monkeypatch):
    own = lambda: QUERIES["eligibility_reasons"](spark, SMALL.replace("0.001", "0.01"))
    monkeypatch.setattr(offers, "TASK_PAIRS", 5_000, raising=False)
    got = own().withColumn("task", F.spark_partition_id()).collect()
    tasks = [[r.offer_id for r in got if r.task == t] for t in sorted({r.task for r in got})]
    assert max(map(len, tasks)) < 2 * 5_000 and len(tasks) * 5_000 > len(got)
    for ids in tasks:
        assert sum(a != b for a, b in zip(ids, ids[1:])) + 1 == len(set(ids))  # an offer's pairs stand together
    monkeypatch.setattr(offers, "KNOWN", 0)  # too many profiles to send to every task
    assert sorted(tuple(r)[:4] + (r.cost or 0,) for r in own().collect()) == sorted(tuple(r)[:4] + (r.cost or 0,) for r in got)


def test_few_profiles_go_to_every_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        plan = QUERIES["eligibility_reasons"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(country" not in plan and "rangepartitioning(country" in plan


def test_checks_that_fail_are_looked_up(spark):
    rows = spark.range(16).selectExpr("CAST(id AS INT) AS bits").select(eligibility.failing("bits").alias("a"), eligibility.failing("bits", ",").alias("t")).collect()
    assert [r.t for r in rows] == [",".join(r.a) for r in rows] and rows[0].a == [] and rows[11].a == ["customer_type", "amount_min", "term"]


def test_lines_that_texts_share_are_read_once(monkeypatch):
    seen, own = [], extraction.position_key
    monkeypatch.setattr(extraction, "position_key", lambda s: seen.append(s) or own(s))
    read = extraction.line_reader(extraction.RULES)
    common, long = "Kampanya 31.12.2026 tarihine kadar geçerli.", "Bu sayfa bilgilendirme içindir. " * 20
    texts = [f"Aylık kar payı oranı %{n},5.\n{common}\n{long}" for n in range(1, 9)]
    found = [[(extraction.RULES[i].field, t[a:b]) for i, a, b, _ in extraction.spans_of(t, extraction.RULES, read)] for t in texts]
    assert found == [[("rate", f"%{n},5"), ("ends_on", "31.12.2026")] for n in range(1, 9)]
    assert seen.count(common) == 1 and seen.count(long) == 8 and len(seen) == 17  # lines too long to hold are read each time


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_a_table_are_parted_once(spark):
    made = plan_of(spark.range(1).select(tables.column_owner(F.lit("a|b|1|2").substr(F.lit(1), F.col("id")), F.col("id"))))
    assert made.count("split(") <= 2


def test_a_quote_is_looked_for_by_one_pattern(spark):
    made = plan_of(spark.range(1).select(tables.spaceless(F.col("id").cast("string"), F.col("id").cast("string"))))
    assert "regexp_instr" not in made and made.count("regexp_substr") == 1
    rows = spark.createDataFrame([("ab a  b", "a b"), ("xa \nb", " ab"), ("ab", "ac"), ("ab", " "), (None, "a"), ("a.b a b", "a b")], "t string, q string")
    got = [tuple(r.s) if r.s else None for r in rows.select(tables.spaceless(F.col("t"), F.col("q")).alias("s")).collect()]
    assert got == [(0, "ab"), (1, "a \nb"), None, None, None, (4, "a b")]


def test_cells_are_settled_in_one_pass_over_them(spark):
    cells = spark.sql("SELECT CAST(id AS STRING) AS doc, 'rate' AS field, 1.0D AS value, 'percent' AS unit, '%1' AS raw FROM range(3)")
    docs = spark.sql("SELECT CAST(id AS STRING) AS doc, '%1' AS text FROM range(3)")
    assert plan_of(gates.settled(cells, docs, {"rate": (0.1, 15.0)}, {"rate": "percent"})).count("Join ") == 1


@pytest.mark.parametrize("name, part", [("fee_free", "tahsis ücreti alınır"), ("statements", "Herkese açık"), ("range_ends", "; geçerlilik ")])
def test_sentences_are_made_once(spark, name, part):
    assert plan_of(QUERIES[name](spark, SMALL)).count(part) == 1


def test_headings_of_tiers_are_read_once(spark):
    assert plan_of(spark.range(1).select(conditions.tier_max(F.col("id").cast("string")))).count("âîûışğüöç'") <= 4  # with those of the amounts and ratios


def test_forms_of_words_are_looked_at_once_a_group(spark):
    rows = spark.sql("SELECT 'a' AS group, CAST(id AS STRING) AS name FROM range(3)")
    made = plan_of(topics.topics(rows, spark.sql("SELECT 'x' AS word")))
    assert "lambda" not in made[made.index("yor|digi") - 200 : made.index("yor|digi")]


def test_condition_answers_ask_for_customers_alone(spark, monkeypatch):
    seen, own = [], retrieval.nearest_records
    monkeypatch.setattr(retrieval, "nearest_records", lambda v, q, *a: seen.append((q.count(), *a)) or own(v, q, *a))
    QUERIES["condition_answers"](spark, SMALL)
    customers, vectors = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("customer", "embeddings"))
    assert seen == [(customers.where("c_custkey % 100 = 0").join(vectors, F.col("c_custkey") == F.col("vec_id")).count(), 3)]


def test_keys_of_texts_are_made_once(spark):
    own = spark.createDataFrame([(1, "Kâr Payı oranı"), (2, "vade"), (3, ""), (4, None)], "text_id int, text string")
    found = terms.longest(spark.createDataFrame([("kar payi",), ("vade",), ("",)], "key string"), own)
    assert sorted(map(tuple, found.collect())) == [(1, "kar payi"), (2, "vade")]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_keys_fold_letters_as_before(spark):
    said = ["IİıiI", "i̇İ İ̇", "ÂÎÛâîû ŞĞÜÖÇ şğüöç", "Σ ΣΑΣ ΑΣI ΣI", " a b\t'’ʼ´` c ", "1.000 TL - %3,5!", "ŞİRKET'in", "̇", "", None]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    key = F.trim(F.regexp_replace(F.translate(text.lower_tr(F.col("s")), "âîûışğüöç" + text.APOSTROPHES, "aiuisguoc"), r"(?U)\s+", " "))
    plain = F.trim(F.regexp_replace(key, r"[^0-9\p{L}]+", " "))
    for got in rows.select(key, plain, text.search_key(F.col("s")), terms.plain_key(F.col("s"))).collect():
        assert got[:2] == got[2:]


def test_conditions_of_a_text_are_read_once(spark):
    rows = spark.sql("SELECT id, IF(id % 3 = 0, NULL, concat('Finansman en az ', 1000 * (id % 3), ' TL kullandırılır.')) AS text, IF(id = 4, 500.0D, 9000.0D) AS amount_max, 12 AS term_months FROM range(6)")
    got = conditions.derived(rows)
    assert {r.id: (r.amount_min, r.amount_max, r.products) for r in got.collect()} == {i: ([None, 1000.0, 2000.0][i % 3] if i != 4 else None, 500.0 if i == 4 else 9000.0, []) for i in range(6)}
    made = plan_of(got)
    below = made.index("+- ", made.index("Aggregate [_text"))
    assert "asgari" in made[:below] and "asgari" not in made[below:]


def test_shared_places_hold_one_table_of_places(spark):
    rows = [("a", "rate", 5), ("a", "term", 5), ("a", "rate", 9), ("a", "rate", 9), ("b", None, 1), ("b", "rate", 1), ("b", None, 2), ("c", "rate", 5), ("c", "term", None), ("c", "fee", None)]
    cells = spark.createDataFrame([(d, f, 1.0, "lira", at, "x") for d, f, at in rows], "doc string, field string, value double, unit string, start int, quote string")
    got = tables.contract_counters(cells, spark.createDataFrame([("a", "01234x")], "doc string, text string"))
    assert tuple(got.first()) == (10, 0, 8, 0, 2)
    assert "distinct" not in plan_of(got)


def test_draws_are_made_in_many_tasks(spark):
    from offerlens.plans import records  # noqa: F401

    made = plan_of(QUERIES["bootstrap_ci"](spark, SMALL))
    assert "windowspecdefinition(1," not in made and "RepartitionByExpression [place" in made


def test_draws_are_not_broadcast(spark):
    from offerlens.plans import records  # noqa: F401

    got = QUERIES["bootstrap_ci"](spark, SMALL)
    got.collect()
    made = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [cast(place" in made
