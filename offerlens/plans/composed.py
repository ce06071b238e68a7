"""Queries that read values back out of sentences made from the columns of every line; the SQL has the columns themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import conditions, extraction, gates as gate_passes
from offerlens.plans import query, table
from offerlens.plans.offers import OFFERS_SQL, offers

LINES_SQL = """
    WITH lines AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(l_linenumber AS INTEGER) AS n, CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_tax * 100) AS INTEGER) AS t,
               CAST(l_quantity AS INTEGER) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p, CAST(l_shipdate AS DATE) + 3653 AS day, l_extendedprice AS price
        FROM lineitem)
"""
# Names of the months.
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small whole numbers, an amount and a day of every line."""
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_linenumber").cast("int").alias("n"), cents("l_discount").alias("d"), cents("l_tax").alias("t"),
        F.col("l_quantity").cast("int").alias("q"), F.floor("l_extendedprice").alias("p"), F.date_add(F.col("l_shipdate").cast("date"), 3653).alias("day"), F.col("l_extendedprice").alias("price"),
    )


def lira(c: Column) -> Column:
    """An amount as it is written, with points for thousands."""
    return F.translate(F.format_number(c.cast("long"), 0), ",", ".")


def dotted(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yyyy")


def by_line(first: dict[int, Column | str], rest: Column | str) -> Column:
    """A text for each line number, and one for the others."""
    made = lambda x: F.lit(x) if isinstance(x, str) else x
    out = made(rest)
    for n, c in first.items():
        out = F.when(F.col("n") == n, made(c)).otherwise(out)
    return out


@query(LINES_SQL + """SELECT id, CASE WHEN n = 7 THEN d::DOUBLE / 10 ELSE (d * 100 + t)::DOUBLE / 100 END AS rate, CASE n % 3 WHEN 0 THEN p::DOUBLE WHEN 1 THEN d * 1000000.0::DOUBLE ELSE q * 1000.0::DOUBLE END AS money,
    CASE WHEN n % 2 = 1 THEN q ELSE q * 12 END AS months, day FROM lines""")
def value_parsers(spark, sf_dir):
    """Rates, amounts, terms and dates, in the spellings that sentences use."""
    n, odd = F.col("n"), F.pmod("n", F.lit(2)) == 1
    percent = F.concat(F.col("d").cast("string"), F.lit(","), F.lpad(F.col("t").cast("string"), 2, "0"))
    rate = F.when(n == 7, F.concat(F.lit("binde "), "d", F.lit(" oranında"))).when(odd, F.concat(F.lit("aylık %"), percent)).otherwise(F.concat(F.lit("yüzde "), percent, F.lit(" kâr payı")))
    money = F.when(n % 3 == 0, F.concat(lira(F.col("p")), F.lit(" TL'ye kadar"))).when(n % 3 == 1, F.concat("d", F.lit(" milyon TL"))).otherwise(F.concat("q", F.lit(" bin ₺")))
    term = F.when(odd, F.concat("q", F.lit(" ay vadeli"))).otherwise(F.concat("q", F.lit(" yıla varan vade")))
    name = F.get(F.array(*map(F.lit, MONTHS)), F.month("day") - 1)
    day = F.when(odd, dotted(F.col("day"))).otherwise(F.concat_ws(" ", F.dayofmonth("day"), name, F.year("day")))
    return lines(spark, sf_dir).select("id", text.rate(rate).alias("rate"), text.money(money).alias("money"), text.term_months(term).alias("months"), text.date(day).alias("day"))


@query(LINES_SQL + "SELECT id, CASE n WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 5 THEN false WHEN 6 THEN true END AS fee_free, n IN (1) AS denied FROM lines")
def fee_free(spark, sf_dir):
    """Whether each sentence says that financing is free of fees, and whether it denies."""
    said = by_line({
        1: "Konut finansmanında dosya masrafı yoktur", 2: "İhtiyaç finansmanı tahsis ücreti alınır", 3: "Masrafsız taşıt finansmanı", 4: "FAST ile para transferi ücretsiz",
        5: F.concat(F.lit("Konut finansmanı dosya masrafı "), lira(F.col("p")), F.lit(" TL")), 6: "Ekspertiz ücreti banka tarafından karşılanır",
    }, "Kampanya tüm şubelerde geçerlidir")
    rows = lines(spark, sf_dir).select("id", said.alias("said"))  # made once
    return rows.select("id", text.fee_free(F.col("said")).alias("fee_free"), text.denied(F.col("said")).alias("denied"))


# a passage longer than a rule's window, without a keyword
APART = "\n" + "Bu sayfa bilgilendirme içindir, banka dilediği an koşulları yeniden belirleyebilir. " * 2 + "\n"


# what a campaign text made from every line states, and which of it is plausible
FIELDS_SQL = LINES_SQL + """, stated AS (SELECT concat_ws('-', id, q, p, d, t) AS id, unnest(['rate', 'term_months', 'amount_max', 'ends_on', 'fee', 'reward', 'discount', 'points', 'instalments']) AS field,
        unnest([(d * 100 + t)::DOUBLE / 100, greatest(q, n + 2)::DOUBLE, p::DOUBLE, date_diff('day', DATE '1970-01-01', day)::DOUBLE, CASE WHEN n <> 3 THEN q * 10.0::DOUBLE END, q * 100.0::DOUBLE, d + 1.0::DOUBLE, q * 20.0::DOUBLE, n + 2.0::DOUBLE]) AS value FROM lines),
    found AS (SELECT * FROM stated WHERE value IS NOT NULL AND CASE field WHEN 'rate' THEN value = 0 OR (value > 0.10 AND value < 15) WHEN 'amount_max' THEN value > 5000 ELSE true END)
"""


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, dealt out, as a table of one file would be worked through by one task."""
    return lines(spark, sf_dir).repartition(max(32, spark.sparkContext.defaultParallelism))


def campaign_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a campaign text with the nine fields of every line."""
    percent = F.concat(F.col("d").cast("string"), F.lit(","), F.lpad(F.col("t").cast("string"), 2, "0"))
    q, n = F.col("q"), F.col("n")
    body = F.concat(
        F.lit("Konut finansmanı kampanyası: aylık kar payı oranı %"), percent, F.lit(".\n"), q, F.lit(" ay vade ile "), lira(F.col("p")), F.lit(" TL finansman tutarı.\nKampanya "), dotted(F.col("day")),
        F.lit(" tarihine kadar geçerli." + APART + "Dosya masrafı "), q * 10, F.when(n == 3, " TL alınmaz.").otherwise(" TL alınır."), F.lit(APART + "Size "), q * 100, F.lit(" TL hediye çeki." + APART + "Ürünlerde %"), F.col("d") + 1,
        F.lit(" indirim." + APART + "Toplam "), q * 20, F.lit(" TL puan." + APART + "Peşin fiyatına "), n + 2, F.lit(" taksit."),
    )
    return dealt(spark, sf_dir).select(F.concat_ws("-", "id", "q", "p", "d", "t").alias("id"), body.alias("text"))


@query(FIELDS_SQL + "SELECT id AS doc, field, value, CASE WHEN field IN ('rate', 'discount') THEN 'percent' WHEN field IN ('term_months', 'instalments') THEN 'month' WHEN field = 'ends_on' THEN 'day' ELSE 'lira' END AS unit FROM found")
def extract_fields(spark, sf_dir):
    """The nine fields of a campaign text made from every line: implausible values are not fields, nor is a fee that is denied (line 3)."""
    return extraction.extracted(campaign_texts(spark, sf_dir), id_col="id").select("doc", "field", "value", "unit")


@query(LINES_SQL + """SELECT id, CASE WHEN n IN (1, 6) THEN 0.0::DOUBLE END AS rate, CASE n WHEN 1 THEN 'Vade farksız ' || q || ' taksit imkanı' WHEN 6 THEN q || ' ay boyunca kâr payı alınmaz' END AS rate_said,
    CASE n WHEN 4 THEN false WHEN 5 THEN true END AS fee_free, CASE n WHEN 5 THEN 'Masrafsız konut finansmanı' END AS evidence FROM lines""")
def statements(spark, sf_dir):
    """Zero rates and freedom from fees that whole texts state, and the sentence that says the latter."""
    said = by_line({
        1: F.concat(F.lit("Fırsat! Vade farksız "), F.col("q"), F.lit(" taksit imkanı.")), 6: F.concat(F.col("q"), F.lit(" ay boyunca kâr payı alınmaz. Başvurun.")), 2: F.concat(F.lit("Vade farksız değil, aylık %"), F.col("q"), F.lit(" oran.")), 3: "Faizsiz bankacılık ilkeleriyle aylık oran belirtilmemiştir.",
        4: "Konut finansmanında dosya masrafı yoktur. Tahsis ücreti alınır.", 5: "Herkese açık kampanya. Masrafsız konut finansmanı! Hemen başvurun.",
    }, F.concat(F.lit("Aylık %"), F.col("d"), F.lit(" oran.")))
    rows, said = lines(spark, sf_dir).select("id", said.alias("said")), F.col("said")  # made once
    free = conditions.free_statement(said)
    evidence = F.when(free, conditions.first_sentence(said, F.lit(True)))
    rate = conditions.zero_rate(said)
    return rows.select("id", rate.alias("rate"), F.when(rate == 0, conditions.zero_sentence(said)).alias("rate_said"), free.alias("fee_free"), evidence.alias("evidence"))


@query(LINES_SQL + """SELECT id, CASE n WHEN 7 THEN NULL WHEN 2 THEN q * 1000.0::DOUBLE WHEN 3 THEN q * 1000000.0::DOUBLE WHEN 4 THEN q * 1000.0::DOUBLE ELSE p::DOUBLE END AS low,
    CASE n WHEN 7 THEN NULL WHEN 2 THEN (q + 100) * 1000.0::DOUBLE WHEN 3 THEN (q + 1) * 1000000.0::DOUBLE WHEN 4 THEN (q + 1) * 1000.0::DOUBLE ELSE (p + 1000 * q)::DOUBLE END AS high,
    CASE WHEN n = 5 THEN make_date(year(day + q), month(day), least(day(day), 28)) WHEN n < 7 THEN day END AS start_day, CASE WHEN n < 7 THEN day + q END AS end_day FROM lines""")
def range_ends(spark, sf_dir):
    """Both ends of amount and date ranges in the spellings that sentences use; a lone amount or day is no range."""
    n, q, p, day, until = F.col("n"), F.col("q"), F.col("p"), F.col("day"), F.date_add("day", F.col("q"))
    name = lambda d: F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1)
    spelled = lambda d: F.concat_ws(" ", F.dayofmonth(d), name(d), F.year(d))
    many = by_line({
        1: F.concat(lira(p), F.lit(" TL ile "), lira(p + 1000 * q), F.lit(" TL arası")), 2: F.concat(q, F.lit(" bin - "), q + 100, F.lit(" bin TL")), 3: F.concat(q, F.lit(" milyon TL ila "), q + 1, F.lit(" milyon TL")),
        4: F.concat(q, F.lit(" – "), q + 1, F.lit(" bin ₺")), 7: F.concat(lira(p), F.lit(" TL")),
    }, F.concat(lira(p), F.lit(" - "), lira(p + 1000 * q), F.lit(" TL arası")))
    days = by_line({
        2: F.concat(spelled(day), F.lit(" - "), spelled(until)), 3: F.concat(dotted(day), F.lit(" ile "), dotted(until), F.lit(" arasında")), 7: dotted(day),
        5: F.concat(F.least(F.dayofmonth(day), F.lit(28)), F.lit(" "), name(day), F.lit(" – "), spelled(until)),
    }, F.concat(dotted(day), F.lit(" - "), dotted(until)))
    said = F.concat(F.lit("Tutar "), many, F.lit("; geçerlilik "), days, F.lit("."))
    rows, said = lines(spark, sf_dir).select("id", said.alias("said")), F.col("said")  # made once
    got = rows.select("id", conditions.amount_range(said).alias("amount"), conditions.date_range(said).alias("days"))
    return got.select("id", "amount.low", "amount.high", F.col("days.start").alias("start_day"), F.col("days.end").alias("end_day"))


@query(LINES_SQL + "SELECT id, CASE WHEN n % 4 IN (2, 3) THEN greatest((400000 + p)::DOUBLE * 70 / 100, (800000 + p)::DOUBLE * 50 / 100) END AS most FROM lines")
def tier_table_max(spark, sf_dir):
    """The largest financing of a tier table; tables of one row and those with an open end have none."""
    row = lambda base, percent: F.concat(lira(F.col("p") + base), F.lit(f" TL | %{percent}\n"))
    head, one, two = F.lit("Taşıt değeri | Kredi oranı\n"), row(400_000, 70), row(800_000, 50)
    turned = lambda base, percent: F.concat(F.lit(f"| Yeni | %{percent} | "), lira(F.col("p") + base), F.lit(" TL |\n"))
    other = F.concat(F.lit("| Durum | Kredi oranı | Taşıt değeri |\n"), turned(400_000, 70), turned(800_000, 50))
    body = F.when(F.col("n") % 4 == 3, other).when(F.col("n") % 4 == 1, F.concat(head, one)).when(F.col("n") % 4 == 0, F.concat(head, one, two, F.lit("üzeri | %20\n"))).otherwise(F.concat(head, one, two))
    return lines(spark, sf_dir).select("id", conditions.tier_max(body).alias("most"))


@query(LINES_SQL + """SELECT id, CASE WHEN 1000 * q <= p AND d % 3 <> 1 THEN (1000 * q)::DOUBLE END AS amount_min, CASE WHEN n <= q THEN n END AS term_min,
    CASE n WHEN 1 THEN 'card' WHEN 4 THEN 'insurance' WHEN 5 THEN 'salary' WHEN 7 THEN 'autopay' ELSE '' END AS products, CASE q % 4 WHEN 0 THEN 'retired' WHEN 2 THEN 'student,farmer' ELSE '' END AS segments FROM lines""")
def eligibility_terms(spark, sf_dir):
    """Conditions read from sentences against the offer's own caps: what is denied, excluded or about spending is no condition."""
    q, least = F.pmod("q", F.lit(4)), lira(1000 * F.col("q"))
    amount = F.when(F.pmod("d", F.lit(3)) == 0, F.concat(F.lit("Finansman en az "), least, F.lit(" TL kullandırılır. "))).when(F.pmod("d", F.lit(3)) == 1, F.concat(F.lit("En az "), least, F.lit(" TL alışveriş yapanlara geçerlidir. "))).otherwise(F.concat(F.lit("Asgari "), least, F.lit(" TL tutarlı finansman. ")))
    product = by_line({
        1: "Kredi kartı şartı aranır. ", 2: "Kredi kartı şartı aranmaz. ", 3: "Sigorta poliçesi zorunlu değildir. ", 4: "Sigorta poliçesi yaptırılması zorunludur. ", 5: "Maaş müşterisi olan müşteriler yararlanır. ",
        7: "Otomatik ödeme talimatı verilmesi gereklidir. ",
    }, "Kredi kartı sahipleri de başvurabilir. ")
    segment = F.when(q == 0, "Emekli müşterilere özel.").when(q == 1, "Emekli maaşı alanlar hariç herkese açık.").when(q == 2, "Öğrenci ve çiftçi müşterilere özel.").otherwise("Gençler için değildir.")
    said = F.concat(amount, F.lit("Vade asgari "), F.col("n"), F.lit(" ay. "), product, segment)
    rows = lines(spark, sf_dir).select("id", said.alias("text"), F.col("p").cast("double").alias("amount_max"), F.col("q").alias("term_months"))
    return conditions.derived(rows).select("id", "amount_min", "term_min", F.array_join("products", ",").alias("products"), F.array_join("segments", ",").alias("segments"))


@query(OFFERS_SQL + """, cells AS (SELECT offer_id AS doc, 'rate' AS field, rate AS value, 'percent' AS unit FROM offers WHERE rate IS NOT NULL UNION ALL SELECT offer_id, 'fee', fee, fee_unit FROM offers WHERE fee IS NOT NULL)
    SELECT doc, field, CASE WHEN field = 'rate' AND NOT (value > 0.5 AND value < 9.5) THEN 'range' WHEN field = 'fee' AND unit IS DISTINCT FROM 'lira' THEN 'unit' END AS refused FROM cells""")
def gates(spark, sf_dir):
    """Which gate refuses each cell."""
    o = offers(spark, sf_dir)
    cells = o.where("rate IS NOT NULL").select(F.col("offer_id").alias("doc"), F.lit("rate").alias("field"), F.col("rate").alias("value"), F.lit("percent").alias("unit"))
    cells = cells.unionByName(o.where("fee IS NOT NULL").select(F.col("offer_id").alias("doc"), F.lit("fee").alias("field"), F.col("fee").alias("value"), F.col("fee_unit").alias("unit")))
    return conditions.gated(cells, {"rate": (0.5, 9.5)}, {"fee": "lira"}).select("doc", "field", "refused")


@query(LINES_SQL + """, k AS (SELECT concat_ws('-', id, q, p, d, t) AS doc, *, (d * 100 + t)::DOUBLE / 100 AS r, greatest((400000 + p)::DOUBLE * 70 / 100, (800000 + p)::DOUBLE * 50 / 100) AS tier FROM lines),
    c AS (SELECT doc, 'rate' AS field, r AS value, 'percent' AS unit, CASE WHEN n = 1 AND r > 0 THEN 'rederived' ELSE 'given' END AS origin, CASE WHEN NOT (r = 0 OR (r > 0.10 AND r < 15)) THEN 'range' END AS refused, CASE WHEN n = 1 AND r > 0 THEN 2 ELSE 1 END AS passes FROM k
          UNION ALL SELECT doc, 'amount_max', CASE WHEN n = 2 THEN tier ELSE p::DOUBLE END, 'lira', CASE WHEN n = 2 THEN 'tier' ELSE 'given' END, CASE WHEN n = 2 THEN NULL WHEN p <= 5000 THEN 'range' WHEN n = 3 THEN 'phrase' END, 1 FROM k
          UNION ALL SELECT doc, 'term_months', q::DOUBLE, 'month', CASE WHEN n = 4 THEN 'rederived' ELSE 'given' END, NULL, CASE WHEN n = 4 THEN 2 ELSE 1 END FROM k
          UNION ALL SELECT doc, 'instalments', n + 2.0::DOUBLE, 'month', 'given', CASE WHEN n + 2 > q THEN 'term' END, 1 FROM k)
    SELECT doc, field, value, unit, origin, refused, passes::INTEGER AS passes FROM c""")
def settled_cells(spark, sf_dir):
    """Cells of every line after all passes of the gates: rates a hundred times too large (line 1), amounts of a tier table (2), phrases that are not there (3), wrong units (4)."""
    q, n, p = F.col("q"), F.col("n"), F.col("p")
    percent = F.concat(F.lit("%"), F.col("d").cast("string"), F.lit(","), F.lpad(F.col("t").cast("string"), 2, "0"))
    amount, term, parts = F.concat(lira(p), F.lit(" TL")), F.concat(q, F.lit(" ay")), F.concat(n + 2, F.lit(" taksit"))
    row = lambda base, ratio: F.concat(lira(p + base), F.lit(f" TL | %{ratio}\n"))
    tiers = F.when(n == 2, F.concat(F.lit("\nTaşıt değeri | Kredi oranı\n"), row(400_000, 70), row(800_000, 50))).otherwise("")
    body = F.concat(F.lit("Aylık oran "), percent, F.lit(", "), term, F.lit(", "), parts, F.when(n == 3, "").otherwise(F.concat(F.lit(", "), amount)), tiers)
    rows = lines(spark, sf_dir).withColumn("doc", F.concat_ws("-", "id", "q", "p", "d", "t"))
    rate = (F.col("d") * 100 + F.col("t")) / 100
    most = F.greatest((p + 400_000) * 70 / 100, (p + 800_000) * 50 / 100)
    cell = lambda field, value, unit, raw: F.struct(F.lit(field).alias("field"), value.cast("double").alias("value"), unit.alias("unit"), raw.alias("raw"))
    cells = F.array(
        cell("rate", F.when(n == 1, (rate + 1) * 100 * F.when(rate > 0, 1).otherwise(0)).otherwise(rate), F.lit("percent"), percent), cell("amount_max", F.when(n == 2, most).otherwise(p), F.lit("lira"), F.when(n == 2, "tablo").otherwise(amount)),
        cell("term_months", q, F.when(n == 4, "day").otherwise("month"), term), cell("instalments", n + 2, F.lit("month"), parts),
    )
    got = gate_passes.settled(rows.select("doc", F.inline(cells)), rows.select("doc", body.alias("text")), {"rate": (0.10, 15.0), "amount_max": (5000.0, 1e12), "term_months": (0.0, 361.0)}, {"rate": "percent", "amount_max": "lira", "term_months": "month"})
    return got.select("doc", "field", "value", "unit", "origin", "refused", "passes")


VARIANTS = ["as_is", "point_mark", "wide", "upper", "sign", "sign_after", "word"]


@query("SELECT variant, count(*) AS kept FROM lineitem, (SELECT unnest(" + str(VARIANTS) + ") AS variant) GROUP BY variant")
def robustness_matrix(spark, sf_dir):
    """How many rates of all lines survive each way of writing them: decimal point, spacing, capitals, sign before or after, other words around."""
    whole, part = F.col("d").cast("string"), F.lpad(F.col("t").cast("string"), 2, "0")
    at = lambda before, mark, after="": F.concat(F.lit(before), whole, F.lit(mark), part, F.lit(after))
    forms = [at("yüzde ", ","), at("yüzde ", "."), at("yüzde ", " , "), at("YÜZDE ", ","), at("%", ","), at("", ",", " %"), at("Aylık kâr payı yüzde ", ",", " oranındadır")]
    said = F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), f.alias("phrase")) for v, f in zip(VARIANTS, forms, strict=True)]))
    rows = lines(spark, sf_dir).select(((F.col("d") * 100 + F.col("t")) / 100.0).alias("value"), said)
    return rows.groupBy("variant").agg(F.count_if(F.abs(text.rate(F.col("phrase")) - F.col("value")) < 1e-9).alias("kept"))
