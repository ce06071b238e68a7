"""Queries that score: the rules' fields of every line's text against gold labels, and every answer of the conversations against what it must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import evaluation, extraction
from offerlens.plans import query, table
from offerlens.plans.composed import FIELDS_SQL, campaign_texts, dealt

FIELDS = [r.field for r in extraction.RULES]

# gold of field i of a line: by (quantity + line + i) % 7 not labelled, empty, off by half a percent, wrong, else what the
# text states (plausible or not); orders are labelled too, but have no text
GOLD_SQL = FIELDS_SQL + f""",
    keyed AS (SELECT concat_ws('-', id, q, p, d, t) AS id, q, n FROM lines),
    labelled AS (SELECT s.id, field, value, (q + n + list_position({FIELDS}, field) - 1) % 7 AS k FROM stated s JOIN keyed USING (id)),
    gold AS (SELECT id, field, CASE WHEN k = 1 THEN NULL WHEN field = 'ends_on' THEN value + CASE WHEN k = 3 THEN 1 ELSE 0 END WHEN k = 2 THEN value * 1.005::DOUBLE WHEN k = 3 THEN value * 1.2::DOUBLE ELSE value END AS e FROM labelled WHERE k <> 0),
    cells AS (SELECT gold.field, e, f.value AS v, CASE WHEN e IS NULL OR f.value IS NULL THEN e IS NULL AND f.value IS NULL WHEN gold.field = 'ends_on' THEN e = f.value ELSE greatest(abs(e), abs(f.value)) = 0 OR abs(e - f.value) / greatest(abs(e), abs(f.value)) <= 0.01::DOUBLE END AS same
              FROM gold LEFT JOIN found f ON f.id = gold.id AND f.field = gold.field),
    c AS (SELECT field, count(*) FILTER (WHERE same AND e IS NOT NULL) AS tp, count(*) FILTER (WHERE NOT same AND v IS NOT NULL) AS fp, count(*) FILTER (WHERE NOT same AND e IS NOT NULL) AS fn, count(*) FILTER (WHERE same) AS "right",
                 CASE WHEN field = 'rate' THEN (SELECT count(*) FROM orders) ELSE 0 END AS skipped FROM cells GROUP BY field)
    SELECT *, CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END END AS precision, CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END END AS recall,
           CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c"""


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc and labels (field, kind and expected) of the nine fields of every line, and of orders, which have no text."""
    q, n, p, number = F.col("q"), F.col("n"), F.col("p"), lambda c: c.cast("double")
    stated = {
        "rate": (F.col("d") * 100 + F.col("t")) / 100, "amount_max": p, "instalments": n + 2, "fee": F.when(n != 3, q * 10), "reward": q * 100, "discount": F.col("d") + 1, "points": q * 20,
        "term_months": F.greatest(q, n + 2),  # the number of instalments is a term too, and the larger one is taken
    }
    cells = []
    for i, f in enumerate(FIELDS):
        k = F.pmod(q + n + i, F.lit(7))
        if f == "ends_on":
            value = F.when(k == 2, F.date_format("day", "d.M.yyyy")).otherwise(F.date_add("day", F.when(k == 3, 1).otherwise(0)).cast("string"))
        else:
            v = number(stated[f])
            value = F.when(k == 2, v * 1.005).when(k == 3, v * 1.2).otherwise(v).cast("string")
        cells.append(F.when(k != 0, F.struct(F.lit(f).alias("field"), F.lit("day" if f == "ends_on" else "number").alias("kind"), F.when(k != 1, value).alias("expected"))))
    own = dealt(spark, sf_dir).select(F.concat_ws("-", "id", "q", "p", "d", "t").alias("doc"), F.array_compact(F.array(*cells)).alias("labels"))
    others = table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), "o_orderkey").alias("doc"), F.array(F.struct(F.lit("rate").alias("field"), F.lit("number").alias("kind"), F.lit("1").alias("expected"))).alias("labels"))
    return own.unionByName(others)


@query(GOLD_SQL)
def rule_scores(spark, sf_dir):
    """Counts and ratios of the nine fields that the rules find in every line's text, against its gold labels."""
    return evaluation.rules_scored(gold_of(spark, sf_dir), campaign_texts(spark, sf_dir), id_col="id")


FOLDED = "replace(lower(translate({c}, 'IİŞĞÜÖÇ', 'ıişğüöç')), chr(775), '')"
# a question for every user's turn, answered by the next turn: its first word must stand in the answer and its third must not
JUDGED_SQL = f"""
    WITH u AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w, length(text) AS n FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id, turn, text, length(text) AS n, string_split(text, chr(10)) AS lines FROM conversations WHERE role = 'assistant'),
    j AS (SELECT concat_ws(':', u.conv_id, u.turn) AS question, CASE WHEN u.n % 5 < 3 THEN 's' || u.n % 5 END AS scenario, CASE WHEN a.text IS NULL THEN NULL WHEN a.n > 400 THEN 'list' WHEN a.n > 150 THEN 'condition' ELSE 'definition' END AS intent, u.n % 3 = 0 AS expects_source,
                 (CASE WHEN a.text IS NULL THEN 0 ELSE len(a.lines) - 1 END)::INTEGER AS n_sources,
                 CASE WHEN a.conv_id IS NULL THEN ['unanswered'] ELSE list_filter([
                     CASE WHEN u.n % 4 = 0 AND a.n <= 150 OR u.n % 4 = 1 AND a.n > 400 THEN 'intent' END, CASE WHEN u.n % 3 = 0 AND len(a.lines) = 1 THEN 'no source' END, CASE WHEN u.n % 3 = 1 AND len(a.lines) > 1 THEN 'source' END,
                     CASE WHEN w[1] IS NOT NULL AND NOT contains({FOLDED.format(c="a.text")}, {FOLDED.format(c="w[1]")}) THEN 'missing: ' || w[1] END, CASE WHEN contains({FOLDED.format(c="a.text")}, {FOLDED.format(c="w[3]")}) THEN 'forbidden: ' || w[3] END,
                     CASE WHEN u.n % 2 = 0 AND NOT regexp_matches(a.text, '[,;]') THEN 'blocked' END], lambda x: x IS NOT NULL) END AS faults
          FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)
"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    u, n, w = turns.where("role = 'user'"), F.length("text"), F.split("text", " ")
    kinds = F.when(n % 4 == 0, F.array(F.lit("list"), F.lit("condition"))).when(n % 4 == 1, F.array(F.lit("condition"), F.lit("definition")))
    asked = u.select(
        F.concat_ws(":", "conv_id", "turn").alias("question"), F.when(n % 5 < 3, F.concat(F.lit("s"), n % 5)).alias("scenario"), kinds.alias("intents"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("cited"),
        F.slice(w, 1, 1).alias("must"), F.slice(w, 3, 1).alias("must_not"), (n % 2 == 0).alias("numeric"),
    )
    rows = F.split("text", "\n")
    answers = turns.where("role = 'assistant'").select(
        F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("question"), F.when(n > 400, "list").when(n > 150, "condition").otherwise("definition").alias("intent"), F.slice(rows, F.lit(2), F.size(rows)).alias("sources"),
        F.col("text").alias("said"), F.col("text").rlike("[,;]").alias("cleared"),
    )
    return evaluation.answers_judged(asked, answers)


@query(JUDGED_SQL + "SELECT question, scenario, intent, expects_source, n_sources, array_to_string(faults, '; ') AS faults, len(faults) = 0 AS passed FROM j")
def answer_faults(spark, sf_dir):
    """What is wrong with the answer to every user's turn."""
    return judged(spark, sf_dir).withColumn("faults", F.array_join("faults", "; "))


@query(JUDGED_SQL + """, p AS (SELECT 'all' AS part, NULL AS name, len(faults) = 0 AS good FROM j UNION ALL SELECT 'cited', NULL, n_sources > 0 FROM j WHERE expects_source UNION ALL SELECT 'intent', intent, len(faults) = 0 FROM j UNION ALL SELECT 'scenario', scenario, len(faults) = 0 FROM j WHERE scenario IS NOT NULL)
    SELECT part, name, count(*) AS n, count(*) FILTER (WHERE good) AS passed, count(*) FILTER (WHERE good)::DOUBLE / count(*) AS share FROM p GROUP BY part, name""")
def answer_scores(spark, sf_dir):
    """The share of answers that passed, of citations given, and both by intent and scenario."""
    return evaluation.set_scored(judged(spark, sf_dir))
