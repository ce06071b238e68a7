"""Topic words of every source's documents, and whether what is shown is on the topic; the SQL chooses word by word, as a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import topics
from offerlens.plans import query, table
from offerlens.plans.texts import WORDS

SAME = "({a}[1:5] = {b}[1:5] AND least(length({a}), length({b})) >= 5 OR least(length({a}), length({b})) = 4 AND {a}[1:4] = {b}[1:4])"
CLASH = SAME.format(a="x", b="c.word")

# what other parsers resolve: the first long word of every benchmark item
TOPICS_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, list_distinct({WORDS}) AS w FROM documents), w AS (SELECT doc_id, source, unnest(w) AS word FROM d),
    known AS (SELECT DISTINCT ({WORDS})[1] AS word FROM benchmark),
    v AS (SELECT DISTINCT word FROM w WHERE NOT regexp_matches(word[3:], 'yor|digi|dugu|tigi|tugu') AND NOT (length(word) <= 5 AND regexp_matches(word, '[ae]n$'))),
    s AS (SELECT v.word, count(DISTINCT doc_id) AS df FROM v JOIN w ON v.word[1:4] = w.word[1:4] AND {SAME.format(a="v.word", b="w.word")} GROUP BY v.word),
    f AS (SELECT word, df FROM s WHERE df <= greatest(1, floor((SELECT count(*) FROM documents) * 0.03)) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.word[1:4] = s.word[1:4] AND {SAME.format(a="k.word", b="s.word")})),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS place FROM (SELECT source, word, count(*) AS n, any_value(df) AS df FROM w JOIN f USING (word) GROUP BY source, word)),
    t AS (
        SELECT source, 0::BIGINT AS place, []::VARCHAR[] AS taken, NULL::VARCHAR AS word, 0::BIGINT AS n, 0::BIGINT AS df FROM (SELECT DISTINCT source FROM c)
        UNION ALL
        SELECT c.source, c.place, CASE WHEN len(list_filter(taken, lambda x: {CLASH})) = 0 THEN list_append(taken, c.word) ELSE taken END,
               CASE WHEN len(list_filter(taken, lambda x: {CLASH})) = 0 THEN c.word END, c.n, c.df
        FROM t JOIN c ON c.source IS NOT DISTINCT FROM t.source AND c.place = t.place + 1 WHERE len(taken) < 3),
    chosen AS (SELECT source, len(taken)::INTEGER AS rank, word, n, df FROM t WHERE word IS NOT NULL)
"""


def topics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = table(spark, sf_dir, "benchmark").select(F.get(text.topic_words(F.col("text")), F.lit(0)).alias("word"))
    records = table(spark, sf_dir, "documents").select(F.col("source").alias("group"), F.col("text").alias("name"))
    return topics.topics(records, resolved).withColumnRenamed("group", "source")


@query(TOPICS_SQL + "SELECT source, rank, word, n, df FROM chosen")
def source_topics(spark, sf_dir):
    """The three topic words of every source, with the documents that have them and the spread of their stem."""
    return topics_of(spark, sf_dir)


@query(TOPICS_SQL + f""", a AS (SELECT doc_id, chosen.word, unnest([doc_id, doc_id + 20]) AS shown FROM documents JOIN chosen ON chosen.source = documents.source AND chosen.rank = 1 + doc_id % 3)
    SELECT a.doc_id, bool_and(d.doc_id IS NULL OR len(list_filter(d.w, lambda x: {SAME.format(a="x", b="a.word")})) > 0) AS on_topic FROM a LEFT JOIN d ON d.doc_id = shown GROUP BY a.doc_id""")
def topic_check(spark, sf_dir):
    """For each document an answer about one of its source's topics, which shows it and the one twenty ids on: are they on the topic?"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    chosen = topics_of(spark, sf_dir).select("source", "rank", F.col("word").alias("topic"))
    asked = docs.withColumn("rank", (1 + F.pmod("doc_id", F.lit(3))).cast("int")).join(chosen, ["source", "rank"])
    answers = asked.select(F.col("doc_id").alias("answer"), "topic", F.explode(F.array("doc_id", F.col("doc_id") + 20)).alias("record"))
    checked = topics.on_topic(answers, docs.select(F.col("doc_id").alias("record"), F.col("text").alias("name")))
    return checked.withColumnRenamed("answer", "doc_id")
