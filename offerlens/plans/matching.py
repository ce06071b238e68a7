"""Queries that match names, products and segments, mend cut-off answers, and keep an index of vectors with its state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from offerlens.operators import matching, vectors
from offerlens.operators.questions import CRITERION_CUES
from offerlens.plans import query, shared_folder, table
from offerlens.plans.composed import LINES_SQL, lines
from offerlens.plans.offers import OFFERS_SQL, offers
from offerlens.plans.questions import asked

NAMES_SQL = "SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE length(word) >= 5"


@query(f"SELECT word || 'q' AS word, word AS near, floor(2.0::DOUBLE * length(word) / (2 * length(word) + 1) * 1e6) / 1e6 AS ratio FROM ({NAMES_SQL})")
def near_spellings(spark, sf_dir):
    """The words of all parts' names, each with a letter too many, and the name's word that they stand for."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    wrong = words.where(F.length("word") >= 5).select(F.concat("word", F.lit("q")).alias("word"))
    return matching.near_spellings(wrong, words).withColumn("ratio", F.floor(F.col("ratio") * 1e6) / 1e6)


@query("SELECT c_custkey AS question_id, CASE WHEN c_custkey % 2 = 0 THEN 'kuzey' || c_custkey ELSE 'guney' || c_custkey || 'bank' END AS name FROM customer WHERE c_custkey % 3 <> 0")
def foreign_banks(spark, sf_dir):
    """Questions about banks that are not in the registry, each named in one of two ways; every third names one that is."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    other = F.when(k % 2 == 0, F.concat(F.lit("Kuzey"), k, F.lit(" Bankası oranı kaç?"))).otherwise(F.concat(F.lit("Oran kaç, Güney"), k, F.lit("bank?")))
    named = asked(spark, sf_dir).where("question_id % 3 = 0").select("question_id", F.concat("bank", F.lit(" bankası oranı kaç?")).alias("question"))
    rest = c.where(k % 3 != 0).select(k.alias("question_id"), other.alias("question"))
    return matching.foreign(rest.unionByName(named), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("bank")))


@query("SELECT p_partkey, contains(lower(p_type || ' ' || p_name || ' ' || p_brand), 'economy') AS economy, contains(lower(p_type || ' ' || p_name || ' ' || p_brand), 'brand#13') AS branded FROM part")
def product_filter(spark, sf_dir):
    """Which parts two product labels mean."""
    held = [F.col(c) for c in ("p_type", "p_name", "p_brand")]
    return table(spark, sf_dir, "part").select("p_partkey", matching.of_product("Economy", *held).alias("economy"), matching.of_product("Brand#13", *held).alias("branded"))


@query("SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS retired, coalesce(o_orderstatus IN ('F', 'O'), false) AS student FROM orders")
def segment_filter(spark, sf_dir):
    """Which orders two segments of a nested array mean; some have no array."""
    status = F.col("o_orderstatus")
    nested = F.when(status == "F", '{"eligibility": {"segments": ["retired", "student"]}}').when(status == "O", '{"eligibility": {"segments": ["student"]}}').otherwise('{"other": 1}')
    return table(spark, sf_dir, "orders").select("o_orderkey", matching.in_segment(nested, "retired").alias("retired"), matching.in_segment(nested, "student").alias("student"))


@query(LINES_SQL + "SELECT id, q, CASE WHEN n % 3 = 0 THEN p END AS p FROM lines")
def salvaged_answers(spark, sf_dir):
    """The fields of answers in JSON, two of three cut off in their last field."""
    whole = F.format_string('{"q": %d, "p": %d, "t": 1}', "q", "p")
    cut = F.when(F.col("n") % 3 == 0, whole).when(F.col("n") % 3 == 1, F.format_string('{"q": %d, "p": %d', "q", "p")).otherwise(F.format_string('{"q": %d, "p', "q"))
    rows = lines(spark, sf_dir).select("id", F.from_json(matching.salvaged(cut), "q int, p long").alias("got"))
    return rows.select("id", "got.q", "got.p")


@query("SELECT regexp_replace(url, '#.*', '') AS url, min(page_id) AS first FROM pages WHERE url IS NOT NULL GROUP BY 1")
def first_listed(spark, sf_dir):
    """The listed pages, each once, with the first that has its url."""
    return matching.first_listed(table(spark, sf_dir, "pages"), "url", "page_id")


@query("SELECT label, count(*) AS n, false AS stale, true AS stale_if_changed FROM embeddings GROUP BY label")
def vector_index(spark, sf_dir):
    """An index of all vectors, written and opened again: what it holds, and whether it is stale for the same corpus and a changed one."""
    at, docs = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    vectors.written(table(spark, sf_dir, "embeddings"), docs, "given", at)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 0, "changed").otherwise(F.col("text")))
    state = vectors.stale(spark, at, docs).select("stale", F.lit(1).alias("one")).join(vectors.stale(spark, at, changed).select(F.col("stale").alias("stale_if_changed"), F.lit(1).alias("one")), "one")
    held = vectors.opened(spark, at, "given").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    return held.join(F.broadcast(state), "one").drop("one")


@query("SELECT field, n, total FROM (SELECT 'quality' AS field, count(quality) AS n, count(*) AS total FROM labels UNION ALL SELECT 'toxic', count(toxic), count(*) FROM labels)")
def gold_coverage(spark, sf_dir):
    """How many labelled records each field is labelled in."""
    got = table(spark, sf_dir, "labels").agg(F.count("quality").alias("q"), F.count("toxic").alias("t"), F.count(F.lit(1)).alias("total"))
    return got.selectExpr("stack(2, 'quality', q, total, 'toxic', t, total) AS (field, n, total)")


@query(OFFERS_SQL + "SELECT bank, count(*) AS n, max(ends_on) AS latest FROM offers GROUP BY bank")
def corpus_answer(spark, sf_dir):
    """How many offers of each bank there are, and the latest day of them."""
    return offers(spark, sf_dir).groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.max("ends_on").alias("latest"))


@query("SELECT s_name AS bank, cue, s_name || ' ' || cue AS question FROM supplier, (SELECT unnest(" + str(list(CRITERION_CUES)) + ") AS cue)")
def generated_questions(spark, sf_dir):
    """A question for each bank and cue of a criterion."""
    cues = F.array(*map(F.lit, CRITERION_CUES))
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("bank"), F.explode(cues).alias("cue")).withColumn("question", F.concat_ws(" ", "bank", "cue"))
