"""What campaign sentences state beyond single values: zero rates, freedom from fees, ranges, tier tables and conditions.

Each function takes a text Column, or a frame with one, and stays in Spark's own functions.  Null texts state nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.functions.text import bound_to

# Phrases that state a zero rate, confidences of statements, and the least amount of a tier table.
ZERO_RATE = r"\bvade fark(?:i|si)?siz(?! degil)|\bvade farki (?:olmadan|yok|alinma)|\bkar payi (?:yok|alinma)"
ZERO_CONFIDENCE, FREE_CONFIDENCE, LEAST_TIER = 0.80, 0.91, 10_000.0
# Cues of conditions as search keys; a mark such as \\b makes a cue a pattern.
AT_LEAST = r"\b(?:en az|asgari|minimum|min\.)\s+"
FINANCING = r"(?:finansman|kredi kullan|kullandir|taksitlendir|vade)"
SPENDING = r"(?:alisveris|harcama|islem|sepet|puan|iade|ucret|komisyon|\beft\b|havale|bakiye|market|akaryakit|bsmv|masraf|\bprim|hesap ac)"
OBLIGED = r"sahip ol|olan musteri|musterisi ol|bulunan musteri|kullanan|kullanil|sarti|kosuluyla|kaydiyla|gerekmekte|gerekli|zorunlu|talimat ver|aktif ol|actir|sahibi ol"
PRODUCTS = {
    "salary": r"maasini|maas hesab|maas musteri", "card": r"kredi kart", "autopay": r"(?:otomatik|duzenli) odeme talimat", "insurance": r"sigorta (?:police|yaptir)|sigorta zorunlu", "participation": r"(?:katilim|birikim) hesab",
    "digital": r"mobil sube|internet sube|dijital kanal",
}
SEGMENTS = {
    "retired": r"emekli", "student": r"ogrenci|universiteli", "sme": r"\bkobi\b|kucuk ve orta", "tradesman": r"esnaf", "farmer": r"ciftci|tarim musteri", "woman_entrepreneur": r"kadin girisimci", "young": r"\bgenc(?:lere|ler)?\b",
}
#: Characters around a stated least amount in which its context is sought.
WINDOW = 120


def sentences(c: Column) -> Column:
    """Sentences of a text: parts between ends of lines and marks that a blank or the end follows."""
    return F.filter(F.transform(F.split(c, r"[.!?](?:\s+|$)|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def zero_sentence(c: Column) -> Column:
    """The first sentence that states that there is no rate: the evidence of a zero rate, or null."""
    return F.get(F.filter(sentences(c), lambda s: text.search_key(s).rlike(ZERO_RATE)), F.lit(0))


def zero_rate(c: Column) -> Column:
    """0.0 if the text states that there is no rate and names none above zero, else null."""
    return F.when(text.search_key(c).rlike(ZERO_RATE) & ~(F.coalesce(text.rate(c), F.lit(0.0)) > 0), F.lit(0.0))


def free_statement(c: Column) -> Column:
    """Whether the text says that financing is free of fees, over its sentences: one that says no outweighs those that say yes."""
    return bound_to(F.transform(sentences(c), text.fee_free), lambda said: F.when(F.exists(said, lambda v: ~v), False).when(F.exists(said, lambda v: v), True))


def first_sentence(c: Column, decision: Column) -> Column:
    """The first sentence whose own verdict on fees is the decision: its evidence, or null."""
    return F.get(F.filter(sentences(c), lambda s: text.fee_free(s).eqNullSafe(decision)), F.lit(0))


def amount_range(c: Column) -> Column:
    """Struct of low and high of an amount range, with a dash, "ile" or "ila" between its ends; null without one.

    10.000 - 50.000 TL, 10 bin - 50 bin TL, 10.000 TL ile 50.000 TL arası.  An end without a word such as "bin" takes
    that of the other if it is the low one and a small number: 10 - 50 bin TL.  The low end is not a limit of its own.
    """
    end = rf"(\d[\d.,]*)\s*({'|'.join(text.MULTIPLIERS)})?"
    pattern = rf"(?<![\d.,]){end}\s*{text.CURRENCY}?\s*(?:[-–—]|\bil[ea]\b)\s*{end}\s*{text.CURRENCY}"
    times = lambda word: F.coalesce(text.looked_up(word, text.MULTIPLIERS).cast("double"), F.lit(1.0))

    def read(p: Column) -> Column:
        """From the figures and words of both ends."""
        low, high = text.number(p[0]), text.number(p[2]) * times(p[3])
        word = F.when((p[1] == "") & (low < 1000) & ~F.contains(p[0], F.lit(".")), p[3]).otherwise(p[1])
        return F.struct((low * times(word)).alias("low"), high.alias("high"))

    phrase = F.nullif(F.regexp_extract(F.replace(text.position_key(c), F.lit("₺"), F.lit(" tl")), pattern, 0), F.lit(""))
    return bound_to(phrase, lambda x: F.when(x.isNotNull(), bound_to(F.array(*[F.regexp_extract(x, pattern, i) for i in range(1, 5)]), read)))


def date_range(c: Column) -> Column:
    """Struct of start and end of a date range, in figures or with names of months, with a dash, "ile" or "ila"; null without one.

    1 Ocak - 31 Mart 2026: a start without a year has that of the end.
    """
    named = rf"\d{{1,2}}\s+(?:{'|'.join(text.MONTHS)})"
    day = rf"\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|{named}\s+\d{{4}}"
    pattern = rf"(?<!\d)({day}|{named})\s*(?:[-–—]|\bil[ea]\b)\s*({day})(?!\d)"

    def read(p: Column) -> Column:
        start = F.when(p[0].rlike(r"\d{4}$"), p[0]).otherwise(F.concat_ws(" ", p[0], F.right(p[1], F.lit(4))))
        return F.when(p[1] != "", F.struct(text.date(start).alias("start"), text.date(p[1]).alias("end")))

    ends = lambda key: F.array(F.regexp_extract(key, pattern, 1), F.regexp_extract(key, pattern, 2))
    return bound_to(bound_to(text.position_key(c), ends), read)


def tier_max(c: Column) -> Column:
    """The largest financing that a tier table allows: amount times ratio over its rows, as double.

    A table is lines of cells between bars.  It counts if its header names a base of credit and, in another cell, a
    ratio, wherever they stand; two rows or more must have both, and the last row an amount: an open end has no
    maximum.  Results under LEAST_TIER are none.
    """
    rows = F.transform(F.filter(F.split(c, "\n"), lambda r: F.contains(r, F.lit("|"))), lambda r: F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"))
    heads = lambda header: F.struct(
        (F.array_position(F.transform(header, lambda h: F.contains(h, F.lit("deger")) & ~F.contains(h, F.lit("oran"))), True) - 1).cast("int").alias("base"),
        (F.array_position(F.transform(header, lambda h: F.contains(h, F.lit("oran"))), True) - 1).cast("int").alias("ratio"),
    )

    def most(values: Column) -> Column:
        whole = F.filter(values, lambda v: v["amount"].isNotNull() & v["ratio"].isNotNull())
        largest = F.array_max(F.transform(whole, lambda v: v["amount"] * v["ratio"] / 100))
        return F.when((F.size(whole) >= 2) & F.element_at(values, -1)["amount"].isNotNull() & (largest >= LEAST_TIER), largest)

    def read(table: Column) -> Column:
        body = F.slice(table, F.lit(2), F.size(table) - 1)
        values = lambda at: F.transform(body, lambda r: F.struct(text.money(F.get(r, at["base"])).alias("amount"), text.rate(F.get(r, at["ratio"])).alias("ratio")))
        at = bound_to(F.transform(table[0], text.search_key), heads)
        return bound_to(at, lambda x: F.when((x["base"] >= 0) & (x["ratio"] >= 0), bound_to(values(x), most)))

    return bound_to(rows, lambda table: F.when(F.size(table) >= 3, read(table)))


def named(keys: Column, table: dict[str, str]) -> Column:
    """The names whose cue stands in one of the sentences' keys, in order of the table."""
    return F.array_compact(F.array(*[F.when(F.exists(keys, lambda s: s.rlike(cue)), F.lit(name)) for name, cue in table.items()]))  # noqa: B023


def least_amount(key: Column) -> Column:
    """The first amount after a cue such as "en az" that is a limit of financing: its context within WINDOW says so and names no spending or fee."""
    wide = WINDOW + 60  # looked at from the end of the amount
    near = rf"(?<!{SPENDING}.{{0,{wide}}})(?!.{{0,{WINDOW}}}{SPENDING})(?:(?<={FINANCING}.{{0,{wide}}})|(?=.{{0,{WINDOW}}}{FINANCING}))"
    return text.money(F.regexp_extract(key, rf"{AT_LEAST}({text.AMOUNT}){near}", 1))


def derived(rows: DataFrame, text_col: str = "text", amount_col: str = "amount_max", term_col: str = "term_months") -> DataFrame:
    """Conditions of an offer from its text: amount_min, amount_max, term_min, term_max, products and segments.

    The caps come from the offer's own fields.  The least amount and term stand after a cue such as "en az", the amount
    in a context of financing.  A product counts in a sentence that obliges and does not deny, a segment in one that
    neither denies nor excludes.  Where a least value is above its cap, it is dropped.  Null texts state nothing.
    A text that several offers have is read once; rows and what was read meet by the text's digest.
    """
    own = F.coalesce(F.col(text_col), F.lit(""))
    digest = lambda c: F.unhex(F.sha2(c, 256)).alias("_digest")
    keys = F.transform(sentences(F.col("_text")), text.search_key)
    whole = text.search_key(F.col("_text"))
    denied = rf"{text.DENIES}|\bdegil"
    obliging = lambda k: F.filter(k, lambda s: s.rlike(OBLIGED) & ~s.rlike(denied))
    including = lambda k: F.filter(k, lambda s: ~s.rlike(denied) & ~s.rlike(text.EXCLUDES))
    said = bound_to(keys, lambda k: F.struct(bound_to(obliging(k), lambda o: named(o, PRODUCTS)).alias("products"), bound_to(including(k), lambda i: named(i, SEGMENTS)).alias("segments")))
    low = lambda value, cap: F.when(F.col(cap).isNull() | (value <= F.col(cap)), value)
    term = F.regexp_extract(whole, rf"{AT_LEAST}(\d{{1,3}})\s*ay\b", 1).try_cast("int")
    read = rows.select(own.alias("_text")).distinct().select(digest(F.col("_text")), least_amount(whole).alias("_amount"), term.alias("_term"), said.alias("_said"))
    met = rows.withColumn("_digest", digest(own)).join(read, "_digest")
    return met.withColumns({
        "amount_min": low(F.col("_amount"), amount_col), "term_min": low(F.col("_term"), term_col), "term_max": F.col(term_col),
        "products": F.col("_said.products"), "segments": F.col("_said.segments"),
    }).drop("_digest", "_amount", "_term", "_said")


def gated(cells: DataFrame, limits: dict[str, tuple[float, float]], units: dict[str, str]) -> DataFrame:
    """Reconciled cells (doc, field, value, unit) with the gate that refuses each: unit, range, or null if it passes.

    limits: the exclusive bounds of a field; units: the unit a field must have.  Fields without either pass.
    """
    field, value, out = F.col("field"), F.col("value"), F.lit(None).cast("string")
    for name, (low, high) in limits.items():
        out = F.when((field == name) & ~((value > low) & (value < high)), "range").otherwise(out)
    for name, unit in units.items():
        out = F.when((field == name) & ~F.col("unit").eqNullSafe(F.lit(unit)), "unit").otherwise(out)
    return cells.withColumn("refused", out)
