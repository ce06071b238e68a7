"""Tables laid out as text, glossaries, spellings, quotes that differ by blanks, and answers from what is known."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from offerlens.functions import text, urls
from offerlens.operators import ranking

#: A rule between the head and the rows of a table, and a cell that holds data: no letter, or a figure first.
RULE, DATA = r"^\s*:?-{2,}:?\s*$", r"^\s*(?:[^\p{L}]*|[%₺]?\s*\d.*)$"


def column_owner(t: Column, start: Column, least: int = 2) -> Column:
    """The heading of the table column in which the character at start (from 0) stands; null outside of a table.

    Cells are parted by bars; a table may be laid out on one line.  The data cells before the place are counted back to
    the headings, a run of cells that are not data, and dealt to as many columns as there are headings.
    """
    cells = F.filter(F.split(F.substring(t, F.lit(1), start.cast("int")), r"\|"), lambda c: ~c.rlike(RULE))

    def owner(cells: Column, isdata: Column) -> Column:
        """From the cells and whether each is data; the place's own cell is the last one, cut off where it starts."""

        def of_run(last: Column) -> Column:
            before = F.coalesce(F.array_max(F.transform(isdata, lambda d, i: F.when(d & (i < last), i))), F.lit(-1))
            heads, data = F.slice(cells, before + 2, last - before), F.size(cells) - 1 - last
            return F.when(data > 0, text.bound_to(heads, lambda h: F.when(F.size(h) >= least, F.trim(F.get(h, F.pmod(data - 1, F.greatest(F.size(h), F.lit(1))))))))

        return text.bound_to(F.array_max(F.transform(isdata, lambda d, i: F.when(~d, i))), of_run)

    return text.bound_to(cells, lambda c: text.bound_to(F.transform(c, lambda x: x.rlike(DATA)), lambda d: owner(c, d)))


def spaceless(t: Column, quote: Column) -> Column:
    """struct<start, expression>: where a text first has a quote, blanks aside, from 0, and how it stands there; else null."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    signs = lambda q: F.filter(F.split(q, ""), lambda s: s != "")
    pattern = lambda q: F.concat(F.lit("(?U)"), F.array_join(F.transform(signs(q), lambda s: F.concat(F.lit("\\Q"), s, F.lit("\\E"))), r"\s*"))
    # a row's own pattern is made and run only where the quote stands; the first match's spelling does not stand earlier
    found = text.bound_to(bare(quote), lambda q: F.when((q != "") & F.contains(bare(t), q), F.regexp_substr(t, pattern(q))))
    return text.bound_to(found, lambda x: F.when(x.isNotNull(), F.struct((F.instr(t, x) - 1).alias("start"), x.alias("expression"))))


@F.pandas_udf(StringType())
def composed(t: pd.Series) -> pd.Series:
    """Normal form C, which no built-in function gives."""
    return t.str.normalize("NFC")


def tidy_composed(t: Column) -> Column:
    """The text tidied, letters and their marks composed."""
    return text.tidy(composed(t))


def display_forms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, shown): each word's search key and its spelling at its first place, by id and position.  The earliest of each partition is kept before the shuffle."""
    words = rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"[^0-9\p{L}]+")).alias("at", "raw")).where("raw <> ''")
    return words.groupBy(text.search_key(F.col("raw")).alias("word")).agg(F.min_by("raw", F.struct("id", "at")).alias("shown"))


def glossary(lines: DataFrame) -> DataFrame:
    """(name, key, meaning, code) for each spelling of each term in lines (column value) of tables of three columns.

    The first cell names the term, in bold if parts of it are not the name; a slash parts its spellings.  Heads are
    the rows whose first cell is not bold; rules and lines that are no rows are skipped.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.trim("value").startswith("|")).select(cells.alias("c")).where((F.size("c") >= 3) & F.col("c")[0].rlike(r"\*\*.+?\*\*"))
    named = rows.select(F.array_join(F.regexp_extract_all(F.col("c")[0], F.lit(r"\*\*(.+?)\*\*")), " ").alias("name"), F.col("c")[1].alias("meaning"), F.nullif(F.regexp_extract(F.col("c")[2], "`([^`]+)`", 1), F.lit("")).alias("code"))
    keys = F.array_distinct(F.filter(F.transform(F.split("name", "/"), text.search_key), lambda k: k != ""))
    return named.select("name", F.explode(keys).alias("key"), "meaning", "code")


def site_dimension(registry: DataFrame) -> DataFrame:
    """(host, bank) of a registry with bank and sites (array of urls); of a host that several list, the least bank's."""
    hosts = registry.select("bank", F.explode("sites").alias("url")).select(urls.host(F.col("url")).alias("host"), "bank")
    return hosts.where("host <> ''").groupBy("host").agg(F.min("bank").alias("bank"))


def known_fields(offers: DataFrame) -> DataFrame:
    """(offer_id, field, value, unit) of what offers without a rate do have."""
    unit = {"amount_max": F.lit("lira"), "term_months": F.lit("month"), "fee": F.col("fee_unit"), "reward": F.lit("lira")}
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), u.alias("unit")) for f, u in unit.items()]
    return offers.where("rate IS NULL").select("offer_id", F.inline(F.filter(F.array(*cells), lambda c: c["value"].isNotNull())))


def contract_counters(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """One row over cells (doc, field, value, unit, start, quote) and texts (doc, text): how many there are, without a quote,
    with a quote that does not stand at its start, without a unit, and how many places give values to several fields."""
    joined = cells.join(texts, "doc", "left")
    there = F.coalesce(F.substring("text", F.col("start") + 1, F.length("quote")) == F.col("quote"), F.lit(False))
    # least and largest field, not a count of distinct ones, which would hold four tables of places in a task at once
    places = joined.groupBy("doc", "start").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quote").isNull()).alias("no_quote"), F.count_if(F.col("quote").isNotNull() & ~there).alias("misplaced"),
        F.count_if(F.col("unit").isNull()).alias("no_unit"), F.coalesce(F.min("field") < F.max("field"), F.lit(False)).cast("long").alias("shared"),
    )
    total = lambda c, to: F.coalesce(F.sum(c), F.lit(0)).alias(to)
    return places.agg(total("n", "cells"), total("no_quote", "without_quote"), total("misplaced", "misplaced"), total("no_unit", "without_unit"), total("shared", "shared_places"))


def comparison(offers: DataFrame, scenario: ranking.Scenario | None = None) -> DataFrame:
    """(kind, line, bank, value, rival_value) of an answer that compares the banks of each kind.

    A line for each criterion's winner, with the best of any other bank; `overall`, the best advantage score, ties to the
    least offer; and `fee_free`, the number of banks with an offer free of fees, beside the first of them by name.
    """
    best = ranking.winners(offers, scenario=scenario).select("kind", F.col("criterion").alias("line"), "bank", "value", "rival_value")
    none = F.lit(None).cast("double").alias("rival_value")
    scored = ranking.advantage(offers, scenario=scenario).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)
    top = scored.groupBy("kind").agg(F.min_by(F.struct("bank", "score"), F.struct(-F.col("score"), F.col("offer_id"))).alias("b"))
    free = offers.where("fee_free").groupBy("kind").agg(F.min("bank").alias("bank"), F.countDistinct("bank").cast("double").alias("value"))
    overall = top.select("kind", F.lit("overall").alias("line"), "b.bank", F.col("b.score").alias("value"), none)
    return best.unionByName(overall).unionByName(free.select("kind", F.lit("fee_free").alias("line"), "bank", "value", none))
