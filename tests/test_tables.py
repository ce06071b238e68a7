"""Tables laid out as text, quotes, spellings and glossaries on rows written by hand."""

from pyspark.sql import functions as F

from offerlens.operators import tables


def owner(spark, t, value):
    row = spark.createDataFrame([(t, t.index(value))], "t string, at int")
    return row.select(tables.column_owner(F.col("t"), F.col("at")).alias("o")).first().o


def test_cells_belong_to_their_columns(spark):
    t = "Oranlar\nTerm | Rate | Fee\n|:---|---|---|\n3 | 4,20% | 0,50%\n6 | 4,99% | 1,10%"
    assert owner(spark, "| Term | Rate | Fee | 3 | 4,20% | 0,50% |", "4,20") == "Rate"
    assert owner(spark, "| Term | Rate | 3 Ay | 4,20% | 6 Ay | 5,11% |", "6 Ay") == "Term"
    assert owner(spark, "Only | 3 |", "3") is None and owner(spark, "rate 3, no table", "3") is None and owner(spark, "3", "3") is None
    assert owner(spark, t.replace("\n", " | "), "1,10") is not None


def test_quotes_are_found_blanks_aside(spark):
    rows = spark.createDataFrame([("a 12 500\nTL b", "12500 TL"), ("x (1.5) y", "(1.5)"), ("x 1a5", "1.5"), ("x", " "), (None, "x"), ("x", None)], "t string, q string")
    got = [tuple(r.s) if r.s else None for r in rows.select(tables.spaceless(F.col("t"), F.col("q")).alias("s")).collect()]
    assert got == [(2, "12 500\nTL"), (2, "(1.5)"), None, None, None, None]


def test_first_spelling_is_shown_and_letters_composed(spark):
    rows = spark.createDataFrame([(2, "akaryakıt ÇİFTÇİ"), (1, "Çiftçi, büyük"), (3, None)], "id long, t string")
    got = {r.word: r.shown for r in tables.display_forms(rows, "id", "t").collect()}
    assert got["ciftci"] == "Çiftçi" and got["akaryakit"] == "akaryakıt"
    assert [r.t for r in rows.orderBy("id").select(tables.tidy_composed(F.col("t")).alias("t")).collect()] == ["Çiftçi, büyük", "akaryakıt ÇİFTÇİ", None]


def test_glossary_reads_bold_names_and_all_spellings(spark):
    text = ["| Term | Meaning | Field |", "|---|:--|---|", "| **Dosya masrafı / dosya parası** | a fee | `fee` |", "| **Vade** (ay) | months | – |", "| **Cut** | short |", "prose **bold**", None]
    rows = spark.createDataFrame([(t,) for t in text], "value string")
    got = sorted((r.key, r.meaning, r.code) for r in tables.glossary(rows).collect())
    assert got == [("dosya masrafi", "a fee", "fee"), ("dosya parasi", "a fee", "fee"), ("vade", "months", None)]


def test_contract_counters_of_nothing(spark):
    cells = spark.createDataFrame([], "doc string, field string, value double, unit string, start int, quote string")
    assert tuple(tables.contract_counters(cells, spark.createDataFrame([], "doc string, text string")).first()) == (0, 0, 0, 0, 0)
