"""Matching of names and filters: near spellings, names outside a registry, products, segments, answers cut off in their middle."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from offerlens.functions import text
from offerlens.operators.questions import words_of

CUTOFF, LEAST_LETTERS = 0.88, 5


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters of two words."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


#: Tokens that the prefixes of two alike words must share; their pairs are the join's key.
SHARED = 2


def letters_of(word: Column) -> Column:
    """A word's letters as a set: each with the number of times that it has stood there."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def near_spellings(words: DataFrame, vocabulary: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(word, near, ratio): for each distinct word the vocabulary's most alike, of equal ones the first; none below the cutoff.

    Words under five letters and nulls have none.  The ratio is twice the matched letters over all, so alike words of n
    and m letters have c (n + m) / 2 letters in common at least, and a word of n letters c n / (2 - c) with any.  With
    letters ordered from the rarest, the first ones of two alike words, as many as may differ and SHARED more, share
    SHARED at least: pairs of those are the key of an equi-join.  Only pairs that pass the count of common letters are
    compared.  Cutoffs from 0.5; a common letter alone joins nothing.
    """
    if cutoff < 0.5:
        raise ValueError("below a cutoff of 0.5 short words need not share two letters")
    asked = words.select("word").where(F.length("word") >= LEAST_LETTERS).distinct()
    held = vocabulary.select("word").where(F.length("word") >= LEAST_LETTERS).distinct()
    token = lambda df: df.select("word", F.explode(letters_of(F.col("word"))).alias("t"))
    rarity = token(asked.unionByName(held).distinct()).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        ordered = token(df).join(rarity, "t").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("l")).select(F.col("word").alias(name), F.transform("l", lambda x: x["t"]).alias(f"{name}_l"))
        size = F.size(f"{name}_l")
        first = F.slice(f"{name}_l", F.lit(1), F.least(size, size - F.ceil(size * (cutoff / (2 - cutoff)) - 1e-9).cast("int") + SHARED))
        ordered = ordered.withColumn("p", first)
        pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.concat_ws(" ", F.least(a, b), F.greatest(a, b)))))
        return ordered.withColumn("pair", F.explode(pairs)).drop("p")

    needed = cutoff * (F.length("word") + F.length("near")) / 2 - 1e-9
    met = keyed(asked, "word").join(keyed(held, "near"), "pair").where(F.least(F.length("word"), F.length("near")) >= needed)
    met = met.where(F.size(F.array_intersect("word_l", "near_l")) >= needed).select("word", "near").distinct()
    scored = met.withColumn("ratio", ratio("word", "near")).where(F.col("ratio") >= cutoff)
    best = F.min_by(F.struct("near", "ratio"), F.struct(-F.col("ratio"), F.col("near"))).alias("r")
    return scored.groupBy("word").agg(best).select("word", "r.*")


def recognised_in_steps(questions: DataFrame, banks: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """(question_id, bank, step): banks that a question names, by the first step that names any.

    name: its first two words stand there in turn; word: a word that no other bank's name has; near: a word spelled
    nearly like one of those.  Null and empty questions and names name none.
    """
    questions = questions.select("question_id", text.split_apostrophes(F.col("question")).alias("question"))  # an ending after a name is no part of it
    order = F.filter(F.split(text.search_key(F.col("bank")), "[^0-9a-z]+"), lambda w: w != "")
    named = banks.select("bank", F.concat_ws(" ", F.slice(order, F.lit(1), F.lit(2))).alias("core")).where("core LIKE '% %'").distinct()
    inner = F.filter(F.split(text.search_key(F.col("question")), "[^0-9a-z]+"), lambda w: w != "")
    turns = F.zip_with(inner, F.slice(inner, F.lit(2), F.size(inner)), lambda a, b: F.concat(a, F.lit(" "), b))
    asked = questions.select("question_id", F.explode(F.array_distinct(turns)).alias("core"))
    core = asked.join(named, "core").select("question_id", "bank").distinct().withColumn("step", F.lit("name"))
    rest = questions.join(core, "question_id", "left_anti")
    unique = banks.select("bank", F.explode(words_of(F.col("bank"))).alias("near")).distinct().groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.min("bank").alias("bank")).where("n = 1").drop("n")
    words = rest.select("question_id", F.explode(words_of(F.col("question"))).alias("word"))
    whole = words.join(unique, F.col("word") == F.col("near")).select("question_id", "bank").distinct().withColumn("step", F.lit("word"))
    left = words.join(whole, "question_id", "left_anti")
    nearly = left.join(near_spellings(left, unique.select(F.col("near").alias("word")), cutoff), "word").join(unique, "near").select("question_id", "bank").distinct().withColumn("step", F.lit("near"))
    return core.unionByName(whole).unionByName(nearly)


def foreign(questions: DataFrame, banks: DataFrame) -> DataFrame:
    """(question_id, name): what a question calls a bank although no word of the registry's names is it."""
    key = text.search_key(F.col("question"))
    apart = F.regexp_extract_all(key, F.lit(r"\b([a-z0-9]+) bank(?:asi)?(?![a-z0-9])"), F.lit(1))
    joined = F.regexp_extract_all(key, F.lit(r"\b([a-z0-9]+bank)(?![a-z0-9])"), F.lit(1))
    said = questions.select("question_id", F.explode(F.array_distinct(F.concat(apart, joined))).alias("name"))
    known = banks.select(F.explode(words_of(F.col("bank"))).alias("name")).distinct()
    return said.join(known, "name", "left_anti").select("question_id", "name")


def of_product(label: str, *columns: Column) -> Column:
    """Whether a product's label stands in the row's kind, product or url; hyphens and slashes count as blanks."""
    return F.coalesce(F.contains(text.search_key(F.translate(F.concat_ws(" ", *columns), "-/_", "   ")), text.search_key(F.lit(label))), F.lit(False))


def in_segment(nested: Column, segment: str, path: str = "eligibility.segments") -> Column:
    """Whether the array at the path of a JSON text has the segment; a text without that array has none."""
    schema = "array<string>"
    for name in reversed(path.split(".")):
        schema = f"struct<{name}: {schema}>"
    found = F.from_json(nested, schema)
    for name in path.split("."):
        found = found[name]
    return F.coalesce(F.array_contains(found, segment), F.lit(False))


def salvaged(c: Column) -> Column:
    """A JSON text as it is; an object cut off in its middle up to its last comma, and closed; else null."""
    valid = lambda x: F.get_json_object(x, "$").isNotNull()
    cut = F.concat(F.regexp_extract(c, r"(?s)^\s*(\{.*),", 1), F.lit("}"))
    return F.when(valid(c), c).when(valid(cut), cut)


def first_listed(rows: DataFrame, url: str, order: str) -> DataFrame:
    """(url, first): each url once, without its fragment, with the first place it is listed at."""
    return rows.where(F.col(url).isNotNull()).groupBy(F.regexp_replace(url, "(?s)#.*", "").alias("url")).agg(F.min(order).alias("first"))
