"""Terms of a glossary in texts: the longest that stands there, else the shortest that begins with what is asked, and what a term stands for.

Texts and terms are compared as plain keys: search keys whose runs of anything but letters and digits are one blank.
Both sides are joined by a key of a term's first words, so a glossary and a corpus of any size meet by an equi-join,
and only pairs that share it are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators.dialogue import DEFINITION_CUES

# What a glossary's counterpart says if it keeps a term apart from a field, and if the value is computed, as search keys.
APART, COMPUTED = ["degil", "karistirilmaz", "veto", "sizmasin", "aranmaz"], "hesaplan"
#: Words that part the two things a question tells apart.
PARTING = r" (?:ile|ve|veya) "


def plain_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(text.folded(c), r"[^0-9\p{L}]+", " "))  # blanks are among what is replaced


def counterparts(glossary: DataFrame, column: str = "counterpart") -> DataFrame:
    """The glossary with kind and field: what its first clause says that a term stands for.

    computed: a formula, not a column; confusable: a field that the term must not be taken for; identity: a field, named
    in backticks and lower case; concept: none of these, null counterparts too.  field is that of the first three kinds
    if one is named.  A later clause, after a semicolon, does not count.
    """
    first = F.split(F.coalesce(F.col(column), F.lit("")), ";")[0]
    named = F.transform(F.regexp_extract_all(first, F.lit("`([^`]+)`")), lambda x: F.trim(F.regexp_extract(x, r"^([^=(]*)", 1)))
    field = F.get(F.filter(named, lambda x: x.rlike("^[a-z_][a-z0-9_]*$")), F.lit(0))
    key = text.search_key(first)
    kind = F.when(F.contains(key, F.lit(COMPUTED)), "computed").when(text.any_of(key, APART), "confusable").when(field.isNotNull(), "identity").otherwise("concept")
    return glossary.withColumn("kind", kind).withColumn("field", field)


def first_key(words: Column) -> Column:
    """The join key of a term: its first word and two letters of the second; of one word, four letters, or all of a shorter one."""
    one, two = words[0], F.get(words, F.lit(1))
    several = F.when(F.length(two) >= 2, F.concat(F.lit("2"), one, F.lit(" "), F.left(two, F.lit(2)))).otherwise(F.concat(F.lit("1"), one))
    return F.when(F.size(words) > 1, several).when(F.length(one) >= 4, F.concat(F.lit("4"), F.left(one, F.lit(4)))).otherwise(F.concat(F.lit("1"), one))


def keys_of(words: Column, kinds: set[str]) -> Column:
    """All keys under which a term could stand in a text, of the kinds that terms have."""
    after = F.concat(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit("")))
    ways = {
        "1": F.transform(words, lambda w: F.concat(F.lit("1"), w)),
        "4": F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.concat(F.lit("4"), F.left(w, F.lit(4)))),
        "2": F.filter(F.zip_with(words, after, lambda a, b: F.when(F.length(b) >= 2, F.concat(F.lit("2"), a, F.lit(" "), F.left(b, F.lit(2))))), lambda x: x.isNotNull()),
    }
    return F.array_distinct(F.concat(*[ways[k] for k in sorted(kinds)]))


def stands_in(key: Column, term: Column) -> Column:
    """Whether a text's key has a term's from the start of a word; its last word may go on, unless the term is one of up to three letters."""
    within = F.contains(F.concat(F.lit(" "), key), F.concat(F.lit(" "), term))
    whole = F.contains(F.concat(F.lit(" "), key, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))
    return F.when((F.length(term) <= 3) & ~F.contains(term, F.lit(" ")), whole).otherwise(within)


def longest(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, key): of each text that has any, the longest of the terms (column key, plain keys); of equally long ones the first in order.

    texts has text_id and text.  Null and empty texts and terms have none, repeated terms count once, whole texts are
    searched whatever their length.  Empty tables give no rows; other columns are not read.
    """
    held = terms.select("key").where("key <> ''").distinct().withColumn("k", first_key(F.split("key", " ")))
    kinds = {r[0] for r in held.select(F.left("k", F.lit(1))).distinct().collect()}  # three at most
    if not kinds:
        return texts.select("text_id", F.lit("").alias("key")).limit(0)
    # keys are made once: both uses of them read the same shuffle
    own = texts.select("text_id", plain_key(F.col("text")).alias("own")).repartition("text_id")
    asked = own.select("text_id", F.explode(text.bound_to(F.split("own", " "), lambda w: keys_of(w, kinds))).alias("k"))
    met = asked.join(held, "k").select("text_id", "key")
    found = met.join(own, "text_id").where(stands_in(F.col("own"), F.col("key")))
    return found.groupBy("text_id").agg(F.min_by("key", F.struct(-F.length("key"), F.col("key"))).alias("key"))


def subject(question: Column) -> Column:
    """A question's key without the words that ask for a definition."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain_key(question), rf"(?:{'|'.join(DEFINITION_CUES)})\w*", " "), r"(?:^| )(?:bir|bu|ne|nasil)(?= |$)| {2,}", " "))


def begun(terms: DataFrame, questions: DataFrame) -> DataFrame:
    """(text_id, key): of each question (text_id, text) the shortest term that goes on after its subject, word by word.

    The whole subject counts first, then what "ile", "ve" and "veya" part, from the left; of equally short terms the
    first in order.  Questions without such a term, and nulls, have no row.
    """
    words = F.split("key", " ")
    starts = terms.select("key").where("key <> ''").distinct().where(F.size(words) > 1)
    starts = starts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("part"))
    asked = questions.select("text_id", subject(F.col("text")).alias("s")).where("s <> ''")
    parts = F.when(F.col("s").rlike(PARTING), F.concat(F.array("s"), F.transform(F.split("s", PARTING), lambda x: F.trim(x)))).otherwise(F.array("s"))
    asked = asked.select("text_id", F.posexplode(parts).alias("place", "part"))
    return asked.join(starts, "part").groupBy("text_id").agg(F.min_by("key", F.struct("place", F.length("key"), "key")).alias("key"))


def defined(glossary: DataFrame, questions: DataFrame) -> DataFrame:
    """text_id, key and found (whole or begun): the term that each question asks for, by `longest`, else by `begun`."""
    whole = longest(glossary, questions)
    rest = questions.join(whole, "text_id", "left_anti")
    return whole.withColumn("found", F.lit("whole")).unionByName(begun(glossary, rest).withColumn("found", F.lit("begun")))
