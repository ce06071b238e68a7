"""Gates in passes, and conditions with denial, windows and ranges, on rows written by hand."""

from datetime import date

from pyspark.sql import functions as F

from offerlens.operators import conditions, gates

LIMITS, UNITS = {"rate": (0.1, 15.0), "fee": (0.0, 1e5), "term_months": (0.0, 361.0), "amount_max": (5000.0, 1e9)}, {"rate": "percent", "term_months": "month"}


def test_settled(spark):
    docs = spark.createDataFrame([("a", "Oran %2,05,  36\nay vade, 12 taksit, ücret 300 TL"), ("t", "Değer | Oran\n400.000 TL | %70\n800.000 TL | %50"), ("n", None)], "doc string, text string")
    cells = [
        ("a", "rate", 205.0, "percent", "%2,05"), ("a", "term_months", 36.0, None, "36 ay"), ("a", "instalments", 48.0, "month", "12 taksit"), ("a", "fee", 300.0, "lira", "300 TL"), ("a", "rate", 205.0, "percent", "%9"), ("a", "rate", None, "percent", "oran"), ("a", "rate", 0.0, "percent", None),
        ("t", "amount_max", 400000.0, "lira", None), ("t", "amount_max", 1.0, "lira", "400.000 TL"), ("n", "rate", 2.0, "percent", "%2"), ("x", "rate", 2.0, "percent", "%2"), (None, "rate", 2.0, "percent", "%2"),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, doc string, field string, value double, unit string, raw string")
    got = {r.i: (r.value, r.unit, r.origin, r.refused, r.passes) for r in gates.settled(frame, docs, LIMITS, UNITS).collect()}
    assert got == {
        0: (2.05, "percent", "rederived", None, 2), 1: (36.0, "month", "rederived", None, 2), 2: (48.0, "month", "given", "term", 1), 3: (300.0, "lira", "given", None, 1), 4: (205.0, "percent", "given", "range", 1), 5: (None, "percent", "given", "range", 1),
        6: (0.0, "percent", "given", "phrase", 1), 7: (400000.0, "lira", "tier", None, 1), 8: (400000.0, "lira", "rederived", None, 2), 9: (2.0, "percent", "given", "phrase", 1), 10: (2.0, "percent", "given", "phrase", 1), 11: (2.0, "percent", "given", "phrase", 1),
    }
    assert gates.settled(frame.limit(0), docs, LIMITS, UNITS).count() == 0


def test_conditions_that_deny(spark):
    said = {
        "Emekli maaşı alanlar hariç herkese açık. Kredi kartı şartı aranmaz.": (None, None, [], []), "Sigorta zorunlu değildir.": (None, None, [], []), "Kredi kartı sahibi olan müşteriler. KOBİ ve esnaf.": (None, None, ["card"], ["sme", "tradesman"]),
        "En az 5.000 TL alışverişte, finansman için": (None, None, [], []), "Finansman asgari 20 bin TL, en az 6 ay": (20000.0, 6, [], []), "En az 900 bin TL finansman, minimum 60 ay": (None, None, [], []), None: (None, None, [], []), "": (None, None, [], []),
    }
    rows = spark.createDataFrame([(t, 100000.0, 36) for t in said], "text string, amount_max double, term_months int")
    assert {r.text: (r.amount_min, r.term_min, r.products, r.segments) for r in conditions.derived(rows).collect()} == said


def test_ranges_and_zero_rates(spark):
    said = ["10 bin - 50 bin TL", "10.000 TL ile 50.000 TL arası", "10 - 50 bin TL", "1.000 – 2 milyon ₺", "5.000 TL", "36 ay - 48 ay", None, ""]
    ranges = [r[0] and tuple(r[0]) for r in spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(conditions.amount_range(F.col("t"))).collect()]
    assert ranges == [(10000.0, 50000.0)] * 3 + [(1000.0, 2e6)] + [None] * 4
    said = ["1 Ocak 2026 - 31 Mart 2026", "1 Ocak – 31 Mart 2026", "01.01.2026 ile 31.03.2026 arasında", "1 Ocak 2026", "31.02.2026 - 31.03.2026", None]
    days = [r[0] and tuple(r[0]) for r in spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(conditions.date_range(F.col("t"))).collect()]
    assert days == [(date(2026, 1, 1), date(2026, 3, 31))] * 3 + [None, (None, date(2026, 3, 31)), None]
    said = {"Faizsiz bankacılık ilkeleriyle aylık oran belirtilmemiştir": None, "Vade farksız 6 taksit": 0.0, "Vade farkı olmadan": 0.0, "Vade farksız değil": None, "Kâr payı alınmaz": 0.0, None: None}
    assert {r.t: r.z for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", conditions.zero_rate(F.col("t")).alias("z")).collect()} == said
