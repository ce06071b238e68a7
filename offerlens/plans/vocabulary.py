"""Queries about terms: which of a glossary stand in texts and questions, and what they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import terms
from offerlens.plans import query, table


def plain_sql(c: str) -> str:
    """The SQL of a plain key."""
    return f"""trim(regexp_replace(translate(replace(lower(translate({c}, 'IİŞĞÜÖÇ', 'ıişğüöç')), chr(775), ''), 'âîûışğüöç''’ʼ´`', 'aiuisguoc'), '[^0-9\\p{{L}}]+', ' ', 'g'))"""


# a glossary: the first one to four words of every benchmark item, with a counterpart of one of five kinds
GLOSSARY_SQL = f"""
    g AS (SELECT item_id, array_to_string(string_split({plain_sql("text")}, ' ')[1:1 + item_id % 4], ' ') AS key, ['identity', 'concept', 'confusable', 'computed', 'identity'][1 + item_id % 5] AS kind, CASE item_id % 5 WHEN 0 THEN 'rate' WHEN 2 THEN 'rate' WHEN 4 THEN 'reward' END AS field FROM benchmark),
    t AS (SELECT key, min_by(kind, item_id) AS kind, min_by(field, item_id) AS field FROM g GROUP BY key)
"""


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.split(terms.plain_key(F.col("text")), " "), F.lit(1), (1 + F.pmod("item_id", F.lit(4))).cast("int"))
    said = F.array(*map(F.lit, ["`rate`", "Kavramsal; `rate` vetosu", "`rate` ile karıştırılmaz", "tek alan değil, hesaplanır", "`reward`; `rate` vetosu"]))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("key"), F.get(said, F.pmod("item_id", F.lit(5)).cast("int")).alias("counterpart"))
    told = terms.counterparts(rows)
    return told.groupBy("key").agg(F.min_by("kind", "item_id").alias("kind"), F.min_by(F.struct("field"), "item_id")["field"].alias("field"))


@query(f"""WITH {GLOSSARY_SQL}, d AS (SELECT doc_id, ' ' || {plain_sql("text")} AS own FROM documents)
    SELECT doc_id, key, kind, field FROM (SELECT doc_id, t.key, kind, field, row_number() OVER (PARTITION BY doc_id ORDER BY length(t.key) DESC, t.key) AS r FROM d JOIN t ON t.key <> '' AND CASE WHEN length(t.key) <= 3 AND NOT contains(t.key, ' ') THEN contains(own || ' ', ' ' || t.key || ' ') ELSE contains(own, ' ' || t.key) END) WHERE r = 1""")
def longest_terms(spark, sf_dir):
    """The longest glossary term in each document, and what it stands for."""
    g = glossary(spark, sf_dir)
    found = terms.longest(g, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))
    return found.join(g, "key").select(F.col("text_id").alias("doc_id"), "key", "kind", "field")


# a question for every customer: the whole name of a term, its first word, or what parts that from another
ASKED_SQL = """, n AS (SELECT count(*) AS n FROM benchmark), a AS (SELECT c_custkey, c_custkey % 3 AS k, key, string_split(key, ' ')[1] AS one FROM customer, n JOIN g ON item_id = c_custkey % n.n)"""


@query(f"""WITH {GLOSSARY_SQL}{ASKED_SQL}, q AS (SELECT c_custkey, unnest(CASE k WHEN 0 THEN [key] WHEN 1 THEN [one] ELSE ['qqqq ile ' || one, 'qqqq', one] END) AS part, unnest(CASE k WHEN 2 THEN [0, 1, 2] ELSE [0] END) AS place, CASE k WHEN 0 THEN key || ' nedir' WHEN 1 THEN one || ' nedir' ELSE 'qqqq ile ' || one || ' arasindaki fark nedir' END AS own FROM a),
    w AS (SELECT c_custkey, t.key, 'whole' AS found, row_number() OVER (PARTITION BY c_custkey ORDER BY length(t.key) DESC, t.key) AS r FROM (SELECT DISTINCT c_custkey, own FROM q) JOIN t ON t.key <> '' AND CASE WHEN length(t.key) <= 3 AND NOT contains(t.key, ' ') THEN contains(' ' || own || ' ', ' ' || t.key || ' ') ELSE contains(' ' || own, ' ' || t.key) END),
    b AS (SELECT c_custkey, t.key, 'begun' AS found, row_number() OVER (PARTITION BY c_custkey ORDER BY place, length(t.key), t.key) AS r FROM q JOIN t ON starts_with(t.key, part || ' ') WHERE c_custkey NOT IN (SELECT c_custkey FROM w))
    SELECT c_custkey, key, found, kind, field FROM (SELECT * FROM w WHERE r = 1 UNION ALL SELECT * FROM b WHERE r = 1) JOIN t USING (key)""")
def asked_definitions(spark, sf_dir):
    """The term that every customer's question asks for, whole or begun, and what it stands for."""
    g, n = glossary(spark, sf_dir), table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    words = F.slice(F.split(terms.plain_key(F.col("text")), " "), F.lit(1), (1 + F.pmod("item_id", F.lit(4))).cast("int"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("name"), words[0].alias("one"))
    asking = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).join(items, F.col("item_id") == F.pmod("c_custkey", F.col("n")))
    k = F.pmod("c_custkey", F.lit(3))
    question = F.when(k == 0, F.concat("name", F.lit(" nedir?"))).when(k == 1, F.concat("one", F.lit(" nedir?"))).otherwise(F.concat(F.lit("Qqqq ile "), "one", F.lit(" arasındaki fark nedir?")))
    found = terms.defined(g, asking.select(F.col("c_custkey").alias("text_id"), question.alias("text")))
    return found.join(g, "key").select(F.col("text_id").alias("c_custkey"), "key", "found", "kind", "field")
