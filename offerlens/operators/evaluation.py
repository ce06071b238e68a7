"""Scores against gold labels and question sets: typed comparison of cells, and what an answer must and must not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import extraction

#: The kinds that gold labels are compared as; any other compares spellings.
NUMBER, DAY, FLAG = "number", "day", "flag"


def agrees(kind: Column, expected: Column, found: Column, tolerance: float = 0.01, value: Column | None = None) -> Column:
    """Whether two spellings of a value are the same one: never null; two nulls agree, a null and a value do not.

    Numbers agree up to the tolerance, of the larger one; days by the calendar, in any spelling that a date may have (or
    as 2026-01-31); flags if both are true or both are false; the rest, and what is not of its kind, without regard to
    case and blanks around.  value: the number that found spells, if it is at hand.
    """
    plain = lambda c: F.trim(text.lower_tr(c))
    day = lambda c: F.coalesce(F.to_date(F.regexp_extract(c, r"^\s*(\d{4}-\d\d-\d\d)", 1).try_cast("date")), text.date(c))
    number, flag = (lambda c: c.try_cast("double")), (lambda c: c.try_cast("boolean"))
    typed = F.when(kind == NUMBER, text.near(number(expected), number(found) if value is None else value, tolerance)).when(kind == DAY, day(expected) == day(found)).when(kind == FLAG, flag(expected) == flag(found))
    both = F.coalesce(typed, plain(expected) == plain(found))
    return F.when(expected.isNull() | found.isNull(), expected.isNull() & found.isNull()).otherwise(both)


def scored(gold: DataFrame, predicted: DataFrame, held: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(field, tp, fp, fn, right, skipped, precision, recall, f1) of every field that gold labels.

    gold has doc, field, kind and expected (text; null is labelled empty, and a cell without a row is not labelled and
    not scored); predicted has doc, field and found; held has doc, the records there are.  Labels of records that are
    not held are skipped and counted.  A wrong value is a false positive and a false negative; a value where gold is
    empty, a false positive; none where gold has one, a false negative.  right also counts cells that are empty in both.
    Of repeated predictions of a cell the least counts; each row of gold counts.  The ratios are null if there was
    nothing to find or say.  Empty tables give no rows; other columns are not read.
    """
    found = predicted.where("found IS NOT NULL").groupBy("doc", "field").agg(F.min("found").alias("found"))
    known = held.select("doc").distinct().withColumn("_held", F.lit(True))
    cells = gold.select("doc", "field", "kind", "expected").join(found, ["doc", "field"], "left").join(known, "doc", "left")
    return counted(cells.withColumn("same", agrees(F.col("kind"), F.col("expected"), F.col("found"), tolerance)))


def counted(cells: DataFrame) -> DataFrame:
    """What `scored` gives, of cells: field, expected, found, same and _held (null: its record is not held)."""
    own, same = F.col("_held").isNotNull(), F.col("same")
    n = cells.groupBy("field").agg(
        F.count_if(own & same & F.col("expected").isNotNull()).alias("tp"), F.count_if(own & ~same & F.col("found").isNotNull()).alias("fp"), F.count_if(own & ~same & F.col("expected").isNotNull()).alias("fn"),
        F.count_if(own & same).alias("right"), F.count_if(~own).alias("skipped"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(tp + fp + fn > 0, F.when(b > 0, a / b).otherwise(0.0))
    return n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def rules_scored(gold: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01) -> DataFrame:
    """`scored` of what the rules alone find in the texts; texts that are null are not held, of texts of one id the least value counts.

    gold may also have doc and labels, an array of (field, kind, expected): a row for each record rather than for each
    cell.  Records and labels meet by document, with a column for each field, so that no cell is shuffled on its own.
    """
    rules = extraction.RULES
    values = extraction.values_of(docs, rules, id_col, text_col)
    found = values.groupBy("doc").agg(*[F.min(f"v{i}").alias(f"v{i}") for i in range(len(rules))]).withColumn("_held", F.lit(True))
    labels = F.col("labels") if "labels" in gold.columns else F.array(F.struct("field", "kind", "expected"))
    cells = gold.select("doc", labels.alias("labels")).join(found, "doc", "left").select("_held", *[f"v{i}" for i in range(len(rules))], F.inline("labels"))
    value, day = F.lit(None).cast("double"), F.lit(False)
    for i, r in enumerate(rules):
        value, day = F.when(F.col("field") == r.field, F.col(f"v{i}")).otherwise(value), day | (F.col("field") == r.field) if r.kind == "date" else day
    spelled = F.when(day, F.date_add(F.lit("1970-01-01").cast("date"), F.col("value").cast("int")).cast("string")).otherwise(F.col("value").cast("string"))
    number = F.when(~day, F.col("value"))
    cells = cells.select("_held", "field", "kind", "expected", value.alias("value"))
    same = agrees(F.col("kind"), F.col("expected"), spelled, tolerance, number)
    return counted(cells.select("_held", "field", "expected", F.col("value").alias("found"), same.alias("same")))


def macro(scores: DataFrame) -> DataFrame:
    """(macro_f1, fields): the mean of the fields' f1 that are not null; null of none."""
    return scores.agg(F.avg("f1").alias("macro_f1"), F.count("f1").alias("fields"))


def answers_judged(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(question, scenario, intent, expects_source, n_sources, faults, passed) of every question of a set.

    asked has question, scenario, intents (accepted ones), cited, must, must_not (arrays of text) and numeric; answers
    has question, intent, sources (array), said and cleared (whether the shield let it pass).  A null expects nothing,
    as does an empty array.  Faults, in this order: `unanswered` (then no other), `intent`, `no source` and `source`
    (cited is true or false and the answer is not), `missing: ...`, `forbidden: ...` (without regard to case) and
    `blocked` (a numeric question that the shield stopped).  Of repeated answers of a question the first by said
    counts.  A null answer says nothing.
    """
    first = answers.groupBy("question").agg(F.min_by(F.struct("intent", "sources", "said", "cleared"), F.struct("said", "intent", "cleared")).alias("a"), F.lit(True).alias("_any"))
    rows = asked.select("question", "scenario", "intents", "cited", "must", "must_not", "numeric").join(first, "question", "left")
    said, n = text.lower_tr(F.coalesce("a.said", F.lit(""))), F.when(F.col("a.sources").isNull(), 0).otherwise(F.size("a.sources"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.filter(F.coalesce(c, none), lambda x: x.isNotNull())
    one = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(name))).otherwise(none)
    named = lambda c, name, there: F.transform(F.filter(listed(c), lambda x: F.contains(F.col("_said"), text.lower_tr(x)) == there), lambda x: F.concat(F.lit(name), x))
    wrong = (F.size(listed(F.col("intents"))) > 0) & ~F.coalesce(F.array_contains(listed(F.col("intents")), F.col("a.intent")), F.lit(False))
    cleared = F.coalesce("a.cleared", F.lit(False))
    faults = F.concat(
        one(wrong, "intent"), one(F.col("cited") & (F.col("n_sources") == 0), "no source"), one(~F.col("cited") & (F.col("n_sources") > 0), "source"),
        named(F.col("must"), "missing: ", False), named(F.col("must_not"), "forbidden: ", True), one(F.col("numeric") & ~cleared, "blocked"),
    )
    judged = rows.withColumns({"_said": said, "n_sources": n}).withColumn("faults", F.when(F.col("_any").isNull(), F.array(F.lit("unanswered"))).otherwise(faults))
    return judged.select("question", "scenario", F.col("a.intent").alias("intent"), F.coalesce(F.col("cited"), F.lit(False)).alias("expects_source"), "n_sources", "faults", (F.size("faults") == 0).alias("passed"))


def set_scored(judged: DataFrame) -> DataFrame:
    """(part, name, n, passed, share): the whole set, its citations, and each intent and scenario.

    `all`: questions and those that passed.  `cited`: questions that expect a source and those whose answer has one.
    `intent`: answers of each (null: unanswered or unnamed) and those that passed.  `scenario`: the questions of each,
    those without one left out.  share is passed / n.  A set without questions has no rows, one without a question that
    expects a source no `cited`.
    """
    ok, none = F.col("passed"), F.lit(None).cast("string")
    part = lambda p, name, counts, good: F.struct(F.lit(p).alias("part"), name.alias("name"), counts.alias("counts"), good.alias("good"))
    every, scenario = F.lit(True), F.col("scenario")
    parts = F.array(part("all", none, every, ok), part("cited", none, F.col("expects_source"), F.col("n_sources") > 0), part("intent", F.col("intent"), every, ok), part("scenario", scenario, scenario.isNotNull(), ok))
    rows = judged.select(F.inline(parts)).where("counts")
    return rows.groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("passed")).withColumn("share", F.col("passed") / F.col("n"))
