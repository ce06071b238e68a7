"""Questions about offers: which bank, criterion and direction they name, what answers them, and whether an answer's numbers hold.

A question frame has question_id and question.  Vocabularies are tables; matching is by equal words, so that it is a
join whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.functions import text

# Cues as search keys, the more specific ones first, with the column they ask for.
CRITERION_CUES = {"kar payi orani": "rate", "tahsis ucreti": "fee", "kar orani": "rate", "taksit": "term", "masraf": "fee", "odul": "reward", "vade": "term", "oran": "rate", "ucret": "fee"}
# Cues of what is asked for, least or most.
DIRECTION_CUES = {"en dusuk": "least", "en az": "least", "en ucuz": "least", "en kisa": "least", "en yuksek": "most", "en fazla": "most", "en uzun": "most"}


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text.search_key(c), "[^0-9a-z]+"), lambda w: w != ""))


def recognised(questions: DataFrame, banks: DataFrame) -> DataFrame:
    """(question_id, bank): banks that a question names by a word that is in no other bank's name."""
    vocabulary = banks.select("bank", F.explode(words_of(F.col("bank"))).alias("word"))
    unique = vocabulary.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("bank").alias("bank")).where("n = 1")
    asked = questions.select("question_id", F.explode(words_of(F.col("question"))).alias("word"))
    return asked.join(unique, "word").select("question_id", "bank").distinct()


def criterion(question: Column) -> Column:
    """The column of the most specific cue: the first of CRITERION_CUES that the question has."""
    key = text.search_key(question)
    return F.coalesce(*[F.when(F.contains(key, F.lit(cue)), F.lit(name)) for cue, name in CRITERION_CUES.items()])


def direction(question: Column) -> Column:
    """least or most, by the cue that stands earliest."""
    key = text.search_key(question)
    found = F.array(*[F.struct(F.locate(cue, key).alias("at"), F.lit(name).alias("way")) for cue, name in DIRECTION_CUES.items()])
    return F.array_min(F.filter(found, lambda x: x["at"] > 0))["way"]


def filtered_or_original(rows: DataFrame, by: str, condition: Column) -> DataFrame:
    """Of each group, the rows that meet the condition, or all of them if none does."""
    met = F.coalesce(condition, F.lit(False))
    some = rows.where(met).select(by).distinct().withColumn("_some", F.lit(True))
    return rows.join(some, by, "left").where(met | F.col("_some").isNull()).drop("_some")


def refuted(questions: DataFrame, offers: DataFrame, field: str) -> DataFrame:
    """question_id, bank, asked, most, verdict: no if the number asked for is above all that the bank offers, else unknown.

    Only the upper side refutes: a smaller number than asked for may still be offered.
    """
    most = offers.groupBy("bank").agg(F.max(field).alias("most"))
    return questions.join(most, "bank").withColumn("verdict", F.when(F.col("asked") > F.col("most"), "no").otherwise("unknown")).select("question_id", "bank", "asked", "most", "verdict")


def single_answer(candidates: DataFrame) -> DataFrame:
    """The one candidate that answers each question.

    candidates has question_id, offer_id, weight, present (asked fields it has), expired, focus (the value asked for,
    turned so that more is better, null last) and fill.  They count in that order; ties fall to the smaller offer_id.
    """
    order = F.struct(-F.col("weight"), -F.col("present"), F.col("expired"), F.col("focus").isNull(), -F.col("focus"), -F.col("fill"), F.col("offer_id"))
    return candidates.groupBy("question_id").agg(F.min_by("offer_id", order).alias("offer_id"), F.count(F.lit(1)).alias("n"))


def listed(candidates: DataFrame, cap: int = 5) -> DataFrame:
    """The first `cap` candidates of each question with their place: weight, relevance, not expired, present, fill, offer_id."""
    w = W.partitionBy("question_id").orderBy(F.col("weight").desc(), F.col("relevance").desc(), "expired", F.col("present").desc(), F.col("fill").desc(), "offer_id")
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def written_numbers(c: Column) -> Column:
    """The numbers of a text as they are written, marks kept; those of one character are left out."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d.,]*)"), 1), lambda x: F.regexp_replace(x, r"[.,]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def read_number(token: Column) -> Column:
    """A written number's value: points group thousands where a comma follows or all later groups have three digits, else a lone point is decimal.

    0.625 is a fraction, 1.250 is not; 1.2.3 and 1,2,3 are no numbers.
    """
    grouped = token.rlike(r"^[1-9]\d{0,2}(?:\.\d{3})+(?:,\d+)?$")
    plain = F.when(grouped, F.replace(token, F.lit("."), F.lit(""))).when(F.contains(token, F.lit(",")) & F.contains(token, F.lit(".")), None).otherwise(token)
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


def licensed(token: Column, values: Column) -> Column:
    """Whether a written number is one of the values, exactly or rounded to the two or more decimals that it is written with."""

    def same(number: Column) -> Column:
        decimals = F.length(F.regexp_extract(token, r"[.,](\d+)$", 1))
        return F.exists(values, lambda v: (F.abs(v - number) < 1e-9) | ((decimals >= 2) & (decimals <= 3) & (F.abs(v - number) <= 0.5000001 / F.pow(F.lit(10.0), decimals))))

    return text.bound_to(read_number(token), lambda n: F.when(n.isNull(), False).otherwise(F.coalesce(same(n), F.lit(False))))


def day_spellings(days: Column) -> Column:
    """How a day may be written: whole with points, and its year, month and day."""
    return F.flatten(F.transform(days, lambda d: F.array(F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy"), F.date_format(d, "M"), F.date_format(d, "d"))))


def shielded(parts: DataFrame) -> DataFrame:
    """Answer parts with what in them is not backed, by where each comes from.

    parts has origin, content, quote, source, allowed and computed (arrays of double) and days (array of date); null
    arrays are empty.  Numbers are compared by value, with their marks: 1.5 licenses "1,5" and "1,50", not "15".

    structural: every number must be an allowed value or a spelling of a day.  quote: the quote must stand in the source
    word for word, and every number of the content in the quote or among the allowed.  system: every number must be one
    of the computed values, from which it can be made again.  plain: no number at all.  Any other origin is not checked,
    and counted as such.  unbacked lists the numbers, quoted says whether the quote holds (null for other origins), and
    blocked whether the part is held back.  Single digits are not looked at.
    """
    none = F.array().cast("array<double>")
    origin, numbers = F.col("origin"), written_numbers(F.coalesce("content", F.lit("")))
    days = day_spellings(F.coalesce("days", F.array().cast("array<date>")))
    left = lambda values, spelled: F.filter("numbers", lambda t: ~licensed(t, values) & ~F.array_contains(spelled, t))
    rows = parts.withColumn("numbers", numbers).withColumn("quoted", F.when(origin == "quote", F.coalesce(F.contains("source", F.trim("quote")), F.lit(False))))
    own = F.filter(left(F.coalesce("allowed", none), days), lambda t: ~F.array_contains(written_numbers(F.coalesce("quote", F.lit(""))), t))
    unbacked = (
        F.when(origin == "structural", left(F.coalesce("allowed", none), days)).when(origin == "quote", own).when(origin == "system", left(F.coalesce("computed", none), F.array().cast("array<string>")))
        .when(origin == "plain", F.col("numbers")).otherwise(F.array().cast("array<string>"))
    )
    rows = rows.withColumn("unbacked", unbacked).drop("numbers")
    checked = origin.isin("structural", "quote", "system", "plain")
    return rows.withColumn("blocked", (F.size("unbacked") > 0) | ~F.coalesce("quoted", F.lit(True))).withColumn("checked", F.coalesce(checked, F.lit(False)))


def profile(question: Column) -> Column:
    """Struct of amount and months, or null: both must be stated, neither is guessed."""
    amount, months = text.money(question), text.term_months(question)
    return F.when(amount.isNotNull() & months.isNotNull(), F.struct(amount.alias("amount"), months.alias("months")))
