"""Operators on rows written by hand: missing values, ties, vetoes, units, states."""

import datetime

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text, urls
from offerlens import plans
from offerlens.operators import eligibility, extraction, finance, ranking, records, texts
from offerlens.plans import offers as _  # noqa: F401  registers its queries
from offerlens.sources import files
from offerlens.streaming import freshness

OFFER = "offer_id long, bank string, kind string, rate double, amount_max double, term_months int, fee double, fee_unit string, reward double, fee_free boolean, fill double"


def one(spark, value, *columns):
    """Values of Column functions over one text."""
    row = spark.createDataFrame([(value,)], "t string").select(*[c(F.col("t")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return tuple(row)


@pytest.fixture(scope="module")
def offers(spark):
    rows = [
        (1, "a", "home", 2.0, None, 120, 500.0, "lira", None, None, 0.5), (2, "a", "need", 1.5, None, 36, 0.5, "percent", 100.0, None, 0.4), (3, "b", "home", None, None, 60, None, None, 50.0, True, 0.9),
        (4, "b", "card", 0.5, None, None, 10.0, "points", None, None, 0.2), (5, "c", None, 0.1, None, 12, None, None, None, None, 0.2), (6, "c", "home", 2.0, None, 24, 0.0, "lira", 100.0, False, 0.2),
    ]
    return spark.createDataFrame(rows, OFFER)


def test_ranking_puts_missing_and_incomparable_last(offers):
    ids = lambda c, s=None: [r.offer_id for r in ranking.ranked(offers, c, 10, s).orderBy("rank").collect()]
    assert ids("lowest_rate") == [2, 1, 6, 3, 4, 5]
    assert ids("longest_term") == [1, 3, 2, 6, 5, 4]
    assert ids("lowest_fee") == [6, 1, 2, 3, 4, 5]
    assert ids("lowest_fee", ranking.Scenario(10_000, 12)) == [6, 2, 1, 3, 4, 5]


def test_advantage_counts_missing_as_half_and_rewards_free_fees(offers):
    got = {r.offer_id: r for r in ranking.advantage(offers).collect()}
    assert got[3].comparability == pytest.approx(0.6) and got[3].missing == ["rate"]
    assert got[3].score == pytest.approx(0.4 * 0.5 + 0.25 * 0.5 + 0.25 * 0.5 + 0.2 * 0.0 + 0.15 * (60 - 12) / 108)
    assert got[5].comparability == pytest.approx(0.15)
    only = {r.offer_id: r.score for r in ranking.advantage(offers, {"reward": 2.0}).collect()}
    assert only == {1: 0.5, 2: 1.0, 3: 0.0, 4: 0.5, 5: 0.5, 6: 1.0}
    assert ranking.normalized_weights({"rate": -1.0}) == ranking.WEIGHTS


def test_winners_name_the_best_other_bank(offers):
    got = {(r.kind, r.criterion): (r.offer_id, r.value, r.rival_value) for r in ranking.winners(offers).collect()}
    assert got["home", "lowest_rate"] == (1, 2.0, 2.0) and got["home", "longest_term"] == (1, 120.0, 60.0) and got["need", "lowest_rate"] == (2, 1.5, None)
    assert {r.bank: r.offer_id for r in ranking.best_per_bank(offers).collect()} == {"a": 1, "b": 3, "c": 5}


def test_warnings_need_two_offers(offers):
    got = {(r.bank, r.warning): r.blocking for r in ranking.warnings(offers, "bank").collect()}
    assert got["a", "unit_mix"] is True and got["b", "missing_rate"] is False and ("c", "unit_mix") not in got
    assert ranking.warnings(offers.where("offer_id = 1"), "bank").count() == 0


def test_annuity(spark):
    d = spark.createDataFrame([(1000.0, 0.0, 10), (1000.0, 1.0, 12), (0.0, 1.0, 12), (1000.0, 1.0, 0), (1000.0, None, 12)], "a double, r double, n int")
    got = [r[0] for r in d.select(finance.instalment(F.col("a"), F.col("r"), F.col("n"))).collect()]
    assert got[0] == 100.0 and got[1] == pytest.approx(88.8488, abs=1e-4) and got[2:] == [None, None, None]
    grid = {r.months: r for r in finance.sensitivity(spark.createDataFrame([(1, 1.0, 24)], "offer_id long, rate double, term_months int"), 1000.0, [12, 24, 36]).collect()}
    assert sorted(grid) == [12, 24] and grid[24].total_delta == 0.0 and grid[12].total_delta < 0


def test_eligibility_reasons(spark):
    row = dict(profile_id=1, offer_id=1, customer_type="salary", amount=800_000.0, months=120, need_type=None, amount_min=None, amount_max=None, term_min=None, term_max=None, rate=2.0, fee_lira=None, fill=0.5)
    rows = [row, row | {"offer_id": 2, "amount_max": 500_000.0, "term_max": 60}, row | {"offer_id": 3, "need_type": "retired"}, row | {"offer_id": 4, "need_type": "retired", "customer_type": None}, row | {"offer_id": 5, "rate": 0.0, "term_max": 120}, row | {"offer_id": 6, "amount_max": 900_000.0, "amount": None}]
    schema = "profile_id long, offer_id long, customer_type string, amount double, months int, need_type string, amount_min double, amount_max double, term_min int, term_max int, rate double, fee_lira double, fill double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    got = {r.offer_id: r for r in eligibility.tier(eligibility.reasons(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema))).collect()}
    assert (got[1].eligible, got[1].no_data, got[1].tier) == (True, True, 0) and got[1].cost > 800_000
    assert got[2].failed == ["amount_max", "term"] and got[2].tier == 2 and got[2].cost is None
    assert got[3].failed == ["customer_type"] and got[4].eligible and (got[5].cost, got[5].tier) == (None, 1) and got[6].failed == ["amount_max"]


def test_values_in_text(spark):
    assert one(spark, "50.000", text.number) == (50000.0,) and one(spark, "2.05", text.number) == (2.05,) and one(spark, "1.2.3", text.number) == (None,)
    assert one(spark, None, text.number, text.rate, text.money, text.term_months, text.date, text.fee_free) == (None,) * 6
    assert one(spark, "İSTANBUL'un IŞIĞI", text.search_key) == ("istanbulun isigi",)
    assert one(spark, "29.02.2027", text.date) == (None,)
    assert one(spark, "10000000146", text.national_id_valid) == (True,) and one(spark, "10000000147", text.national_id_valid) == (False,)
    assert one(spark, "WWW", lambda c: urls.normalized(F.lit("http://WWW.Ex.com/a/?b=2&utm_source=x&a=1#f"))) == ("https://ex.com/a?a=1&b=2",)


# A format changed, the value stays.
@pytest.mark.parametrize("way", [lambda s: s, lambda s: s.replace(",", "."), lambda s: s.replace("%", "% "), lambda s: s + "\n" + s, str.upper])
def test_extraction_survives_formats(spark, way):
    d = spark.createDataFrame([("d", way("Aylık %1,89 kâr payı oranı ile 120 ay vade."))], "doc_id string, text string")
    got = {r.field: (r.value, r.unit) for r in extraction.extracted(d).collect()}
    assert got["rate"] == (1.89, "percent") and got["term_months"] == (120.0, "month")


def test_extraction_says_nothing_without_evidence(spark):
    d = spark.createDataFrame([("a", "Kampanya koşulları şubede."), ("b", None), ("c", ""), ("d", "2026 yılında 15 kişi"), ("e", "Kâr payı oranı %45")], "doc_id string, text string")
    assert extraction.extracted(d).count() == 0
    cells = extraction.extracted(spark.createDataFrame([("x", "Kâr payı oranı %2,05")], "doc_id string, text string"))
    other = spark.createDataFrame([("x", "something else")], "doc_id string, text string")
    assert [r.grounded for r in extraction.audited(cells, other).collect()] == [False]


def test_ownership_and_choice(spark):
    schema = "doc string, field string, start int, end int, distance int, rule int, confidence double, mode string, value double"
    rows = [("d", "a", 0, 3, 5, 1, 0.9, "highest", 7.0), ("d", "b", 0, 3, 5, 0, 0.9, "first", 7.0), ("d", "a", 9, 12, 1, 1, 0.8, "highest", 5.0), ("d", "a", 20, 22, 1, 1, 0.6, "highest", 99.0)]
    own = records.owners(spark.createDataFrame(rows, schema))
    assert sorted((r.field, r.start) for r in own.collect()) == [("a", 9), ("a", 20), ("b", 0)]
    assert {r.field: r.value for r in records.chosen(own).collect()} == {"a": 5.0, "b": 7.0}


def test_reconciled_layers(spark):
    s = "doc string, field string, value double, confidence double"
    r = spark.createDataFrame([("d", "rate", 2.0, 0.9), ("d", "fee", 5.0, 0.8), ("d", "kind", 1.0, 0.8)], s)
    m = spark.createDataFrame([("d", "rate", 2.01, 0.95), ("d", "fee", 9.0, 0.7), ("d", "kind", 3.0, 0.7), ("d", "term", 3.0, 0.7)], s)
    got = {x.field: (x.value, round(x.confidence, 2), x.method) for x in records.reconciled(r, m, ["rate", "fee"]).collect()}
    assert got == {"rate": (2.0, 1.0, "hybrid"), "fee": (5.0, 0.55, "conflict_rule"), "kind": (3.0, 0.45, "conflict_model"), "term": (3.0, 0.7, "model")}


def test_metrics_tell_null_from_zero(spark):
    pairs = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", None, None), ("c", 1.0, None)], "field string, gold double, predicted double")
    got = {r.field: (r.tp, r.fp, r.fn, r.f1) for r in records.confusion(pairs).collect()}
    assert got == {"a": (1, 1, 1, 0.5), "b": (0, 0, 0, None), "c": (0, 0, 1, 0.0)}
    votes = spark.createDataFrame([("i", "f", w, v) for w, v in zip("xyzw", ["1", "1", "2", "2"])], "id string, field string, who string, value string")
    assert records.majority(votes).count() == 0


def test_containments(spark):
    items = spark.createDataFrame([(1, "b c d"), (2, "b c d e f g h"), (3, "x y"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g hh"), (2, "ab c de"), (3, None), (4, "b c"), (5, "z b  c d")], "doc_id long, text string")
    assert sorted(map(tuple, texts.containments(items, docs).collect())) == [(1, 1), (1, 2), (2, 1)]
    assert texts.containments(items.where("item_id > 2"), docs).count() == 0


def test_containments_of_short_items(spark):
    quotes = {1: "b c d", 2: "b c", 3: "c", 4: "", 5: None, 6: " ", 7: "zz"}
    held = {1: "a b c d e", 2: "ab cd", 3: None, 4: "", 5: "x"}
    want = sorted((i, d) for i, q in quotes.items() for d, t in held.items() if q is not None and t is not None and q in t)
    items, docs = spark.createDataFrame(list(quotes.items()), "item_id long, text string"), spark.createDataFrame(list(held.items()), "doc_id long, text string")
    assert sorted(map(tuple, texts.containments(items, docs).collect())) == want
    assert sorted(map(tuple, texts.containments(items.where("item_id > 1"), docs).collect())) == [r for r in want if r[0] > 1]
    assert texts.containments(items.where("item_id = 5"), docs).count() == 0


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 1.0], 2), (4, [0.0, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in texts.nearest(v, [1.0, 0.0], 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.vec_id for r in texts.nearest(v, [1.0, 0.0], 3, signature=F.col("label")).orderBy("rank").collect()] == [1, 3]
    assert texts.body_text("<html><script>x</script><nav>n</nav><p>One<br>two &amp; three</p><table><tr><td>a<td>b</table>") == "One\ntwo & three\na | b"


def test_freshness_states(spark):
    t = lambda h: datetime.datetime(2026, 8, 1, h)
    rows = [("u", 1, t(1), "x"), ("u", 2, t(2), "x"), ("u", 3, t(3), None), ("u", 4, t(4), "y"), ("u", 5, t(5), "y"), ("v", 1, t(1), None)]
    got = {(r.url, r.seq): (r.state, r.changed_at) for r in freshness.transitions(spark.createDataFrame(rows, "url string, seq long, ts timestamp_ntz, digest string")).collect()}
    assert [got["u", i][0] for i in range(1, 6)] == ["first", "unchanged", "unreachable", "changed", "unchanged"] and got["v", 1] == ("unreachable", None)
    assert got["u", 3][1] is None and got["u", 5][1] == t(4)
    run = freshness.triggers(spark.createDataFrame([(t(8),), (t(9),)], "at timestamp_ntz"), "at", [0, 8, 17]).orderBy("at").collect()
    assert [(r.previous_run.hour, r.next_run.hour) for r in run] == [(8, 17), (8, 17)]


def test_files_round_trip(spark, tmp_path):
    page = [("0299", "B", "https://b.com/x", datetime.datetime(2026, 8, 16, 12), 200, "t", "", "body")]
    files.write_pages(spark.createDataFrame(page, files.PAGE), str(tmp_path / "pages"))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.json").write_text('{"bank": "0299", "url": "https://b.com/x",\n "body": "metin"}')
    (tmp_path / "raw/a.html").write_text("<p>a</p>")
    (tmp_path / "raw/b.html").write_text("<p>b\nc</p>")
    got = files.read_pages(spark, str(tmp_path / "raw")).first()
    assert got.body == "metin" and got.campaign_id.startswith("0299-") and len(got.campaign_id) == 17
    html = files.read_html(spark, str(tmp_path / "raw"))
    assert [r.stem for r in files.unseen(html, spark.createDataFrame([("a",)], "stem string")).collect()] == ["b"]
    (tmp_path / "gold.jsonl").write_text('// note\n\n{"id": "1", "rate": null}\n{"id": "2"}\n')
    gold = {r.id: (r.rate, r.labelled) for r in files.read_gold(spark, str(tmp_path / "gold.jsonl"), "id string, rate double").collect()}
    assert gold == {"1": (None, ["id", "rate"]), "2": (None, ["id"])}
    (tmp_path / "sheet.csv").write_text("﻿id,rate,fee\n1,2.5,\n2,,\n3,?,1\n", encoding="utf-8")
    sheet = {(r.id, r.field): (r.state, r.value) for r in files.read_sheet(spark, str(tmp_path / "sheet.csv"), ["rate", "fee"]).collect()}
    assert sheet == {("1", "rate"): ("value", "2.5"), ("1", "fee"): ("empty", None), ("3", "rate"): ("abstain", None), ("3", "fee"): ("value", "1")}


def test_state_tables_keep_versions(spark, tmp_path):
    at, df = str(tmp_path / "state"), lambda *r: spark.createDataFrame(list(r), "id string, v int")
    files.save_by_key(spark, df(("a", 1), ("b", 1)), at, "id")
    last = files.save_by_key(spark, df(("a", 2), ("c", 2)), at, "id")
    assert {r.id: r.v for r in spark.read.parquet(last).collect()} == {"a": 2, "b": 1, "c": 2} and sorted(files.read_versions(spark, at)) == [0, 1]
    files.append_run(spark, str(tmp_path / "log"), "full", 3, "f1", "2026-08-01 00:00:00")
    files.append_run(spark, str(tmp_path / "log"), "full", 4, "f2", "2026-08-02 00:00:00")
    assert files.latest_run(spark, str(tmp_path / "log")).first().rows == 4


def test_greedy_cover_against_a_plain_version(spark):
    from offerlens.operators import audit

    rows = [("a", "x", ["f", "g"]), ("b", "y", ["f", "g"]), ("c", "x", ["h"]), ("d", "y", ["g", "h", "f"]), ("e", "z", []), ("f", "z", ["f"]), ("g", "x", ["i"])]
    got = [r.id for r in sorted(audit.greedy_cover(spark.createDataFrame(rows, "id string, bank string, fields array<string>"), 2, 9).collect())]
    want, have, used = [], {}, {}
    while True:
        rest = [(-len([f for f in set(fs) if have.get(f, 0) < 2]), used.get(b, 0), i, b, fs) for i, b, fs in rows if i not in want]
        gain, _, i, b, fs = min(rest)
        if not gain:
            break
        want.append(i)
        used[b] = used.get(b, 0) + 1
        for f in fs:
            have[f] = have.get(f, 0) + 1
    assert got == want


def test_conditions_and_questions_by_hand(spark):
    from offerlens.operators import conditions, questions

    assert one(spark, None, conditions.zero_rate, conditions.free_statement, conditions.tier_max, questions.criterion, questions.direction) == (None,) * 5
    assert one(spark, "Vade farksız! Aylık %0.", conditions.zero_rate) == (0.0,) and one(spark, "", conditions.free_statement, questions.profile) == (None, None)
    assert one(spark, "En az 12 ay vade, 50.000 TL", questions.direction, questions.criterion) == ("least", "term")
    read = lambda x: one(spark, x, questions.read_number)[0]
    assert [read(x) for x in ("1,5", "1.5", "1.250", "0.625", "1.234.567,89", "12.50", "31.12.2026", "1,2,3", "1.2,3")] == [1.5, 1.5, 1250.0, 0.625, 1234567.89, 12.5, None, None, None]
    assert one(spark, "x | y\n1 TL | %2", conditions.tier_max) == (None,)


def test_fee_sentences_by_hand(spark):
    """Forms of negation and of charging that no query's sentences have."""
    said = {
        "Konut finansmanında dosya masrafı alınmayacaktır": True, "Kredi için tahsis ücreti alınmıyor": True, "Dosya masrafı yok!": True, "Dosya masrafı alınacaktır": False, "Taşıt finansmanında ekspertiz ücreti yansıtılmaktadır": False,
        "Tahsis ücreti binde 5 oranındadır": False, "Toplam tutar finansman tahsis ücretini içermemektedir": False, "Konut finansmanı kampanyası": None, "50.000 TL'ye kadar dosya masrafı alınmamaktadır.": True, None: None,
    }
    assert {s: one(spark, s, text.fee_free)[0] for s in said} == said
