"""Queries that audit cells, records, labels, sheets and page lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import urls
from offerlens.operators import audit
from offerlens.plans import ORACLE, fixed, query, table
from offerlens.plans.offers import FIELDS, OFFERS_SQL, offers, reconcile_layers

CELLS_SQL = f"WITH cells AS ({ORACLE['reconcile_layers']})"


@query(CELLS_SQL + """SELECT count(DISTINCT doc) AS records, count(value) AS filled, count(value) FILTER (WHERE method = 'rule') AS n_rule, count(value) FILTER (WHERE method = 'model') AS n_model, count(value) FILTER (WHERE method = 'hybrid') AS n_hybrid,
    count(*) FILTER (WHERE method LIKE 'conflict%') AS conflicts, count(DISTINCT doc) * 2 AS cells, floor((count(value)::DOUBLE / (count(DISTINCT doc) * 2)) * 1e4 + 0.5) / 1e4 AS fill_rate, floor(avg(confidence) * 1e4 + 0.5) / 1e4 AS confidence FROM cells""")
def base_metrics(spark, sf_dir):
    got = audit.base_metrics(reconcile_layers(spark, sf_dir), 2)
    return got.withColumns({"fill_rate": fixed("fill_rate", 4), "confidence": fixed("confidence", 4)})


@query(CELLS_SQL + "SELECT doc, count(value)::DOUBLE / 2 AS fill, floor(avg(confidence) * 1e3 + 0.5) / 1e3 AS confidence FROM cells GROUP BY doc")
def record_quality(spark, sf_dir):
    return audit.record_quality(reconcile_layers(spark, sf_dir), 2).withColumn("confidence", fixed("confidence", 3))


@query(CELLS_SQL + "SELECT field, method, count(*) AS n FROM cells GROUP BY ALL")
def run_summary(spark, sf_dir):
    """How many cells of each field each layer settled, conflicts among them."""
    return reconcile_layers(spark, sf_dir).groupBy("field", "method").agg(F.count(F.lit(1)).alias("n"))


@query(OFFERS_SQL + """, counts AS (SELECT count(*) AS total, count(*) FILTER (WHERE rate IS NULL AND amount_max IS NULL AND term_months IS NULL AND fee IS NULL AND reward IS NULL) AS e, count(*) FILTER (WHERE kind IS NULL) AS k FROM offers)
    SELECT 'empty_record' AS finding, e AS n, 0::BIGINT AS threshold, e > 0 AS flagged FROM counts UNION ALL SELECT 'no_kind', k, CAST(floor(total * 0.35::DOUBLE) AS BIGINT), k > floor(total * 0.35::DOUBLE) FROM counts""")
def completeness(spark, sf_dir):
    return audit.completeness(offers(spark, sf_dir), "kind", FIELDS)


@query(OFFERS_SQL + "SELECT bank, count(*) AS n, floor(avg(fill) * 1e6 + 0.5) / 1e6 AS fill, count(*) FILTER (WHERE kind IS NULL) AS no_kind FROM offers GROUP BY bank")
def bank_quality(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("bank").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("fill"), 6).alias("fill"), F.count_if(F.col("kind").isNull()).alias("no_kind"))


TOPICS = {"license": ["license", "copyright"], "contact": ["@", "phone"], "link": ["http", "www."], "number": ["0", "1"]}


@query("SELECT topic, n FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)}) AS {t}" for t, ws in TOPICS.items()) + " FROM documents) s, LATERAL (VALUES " + ", ".join(f"('{t}', s.{t})" for t in TOPICS) + ") v(topic, n)")
def topic_histogram(spark, sf_dir):
    """How many documents have a word of each topic; a document may count for several."""
    low = F.lower("text")
    got = table(spark, sf_dir, "documents").agg(*[F.count_if(F.coalesce(F.greatest(*[F.contains(low, F.lit(w)) for w in [*ws, ws[0]]]), F.lit(False))).alias(t) for t, ws in TOPICS.items()])
    return got.selectExpr(f"stack({len(TOPICS)}, {', '.join(f'{chr(39)}{t}{chr(39)}, {t}' for t in TOPICS)}) AS (topic, n)")


@query("""SELECT doc_id AS id, 'id' AS field, 'unknown' AS problem FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en' AND doc_id IS NOT NULL) UNION ALL SELECT doc_id, 'quality', 'toxic, yet good' FROM labels WHERE quality = 1 AND toxic = 1
    UNION ALL SELECT doc_id, 'toxic', 'not 0 or 1' FROM labels WHERE toxic NOT IN (0, 1)""")
def gold_audit(spark, sf_dir):
    """Labels of records that the audit does not know (here: English ones), and labels that break a rule."""
    gold = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    known = table(spark, sf_dir, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("id"))
    return audit.gold_audit(gold, known, {"quality": (~((F.col("quality") == 1) & (F.col("toxic") == 1)), "toxic, yet good"), "toxic": (F.col("toxic").isin(0, 1), "not 0 or 1")})


@query("SELECT l.doc_id AS id, 'toxic' AS field, 1 AS value FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.toxic = 0 AND length(d.text) > 3000")
def blank_but_found(spark, sf_dir):
    """Fields left empty by people that the system filled surely; long texts stand for sure cells."""
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("field"), F.when(F.col("toxic") == 1, 1).alias("value"))
    cells = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("field"), F.lit(1).alias("value"), F.when(F.length("text") > 3000, 0.9).otherwise(0.3).alias("confidence"))
    return audit.blank_but_found(gold, cells, 0.5)


LEGAL = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 AND o_orderpriority <> '5-LOW' THEN NULL WHEN o_orderkey % 4 = 3 THEN '5-low' ELSE lower(o_orderpriority) END AS repaired,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'priority: not legal' END AS problem FROM orders""")
def sheet_repair(spark, sf_dir):
    """Entries of a sheet, cut and changed in three ways out of four, with the legal value they stand for and what is wrong."""
    o, k = table(spark, sf_dir, "orders"), F.pmod("o_orderkey", F.lit(4))
    entry = F.when(k == 0, F.lower("o_orderpriority")).when(k == 1, F.substring("o_orderpriority", 1, 4)).when(k == 2, F.substring("o_orderpriority", 3, 20)).otherwise(F.when(F.col("o_orderpriority") == "5-LOW", "least").otherwise("??"))
    legal = [v.lower() for v in LEGAL]
    rows = o.select(F.col("o_orderkey").alias("id"), entry.alias("entry"))
    bad = audit.violations({"priority": (F.col("entry").isin(legal), "not legal")})
    return rows.select("id", audit.repaired(F.col("entry"), legal, {"least": "5-low"}).alias("repaired"), F.get(F.transform(bad, lambda v: F.concat_ws(": ", v["field"], v["problem"])), F.lit(0)).alias("problem"))


@query("SELECT doc_id AS id, CAST(CASE WHEN n < 20 THEN -1 ELSE (n - 20) % 3 END AS INTEGER) AS block FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)")
def sheet_split(spark, sf_dir):
    return audit.sheet_split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 20, 3)


@query("""WITH h AS (SELECT sha256(concat_ws('|', doc_id, coalesce(text, ''))) AS h FROM documents)
    SELECT count(*) AS rows, concat_ws('-', CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR)) AS digest FROM h""")
def corpus_fingerprint(spark, sf_dir):
    return audit.corpus_fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def greedy_cover(spark, sf_dir):
    """Ten orders that open most fields: a field for each digit of the key, least used priorities first."""
    o = table(spark, sf_dir, "orders")
    fields = F.array_distinct(F.filter(F.split(F.col("o_orderkey").cast("string"), ""), lambda d: d != ""))
    return audit.greedy_cover(o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("bank"), fields.alias("fields")), 3, 10)


MARKERS = {"/en/": "english", "/fr/": "french", "/de/": "german", "example.org": "organisation"}


@query("SELECT page_id, " + "CASE " + " ".join(f"WHEN contains(lower(url), '{m}') THEN '{k}'" for m, k in MARKERS.items()) + " ELSE 'other' END AS kind FROM pages")
def type_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(urls.kind_of(F.col("url"), MARKERS), F.lit("other")).alias("kind"))


REGISTRY = ["example.com", "example.net", "example.org"]
HOST_PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path"


@query(f"""WITH u AS (SELECT page_id, {HOST_PATH} FROM pages), k AS (SELECT host, path, min(page_id) AS first_page, bool_or(page_id % 3 = 0) AS held FROM u GROUP BY ALL)
    SELECT host || path AS fetch_key, first_page, (SELECT max(d) FROM (VALUES {", ".join(f"('{d}')" for d in REGISTRY)}) r(d) WHERE host = d OR host LIKE '%.' || d) AS site FROM k WHERE NOT held""")
def fetch_plan(spark, sf_dir):
    """Listed pages that are not held yet (a third of them is), each once, with the registered site of their host or null."""
    u = table(spark, sf_dir, "pages").select("page_id", urls.fetch_host(F.col("url")).alias("host"), urls.fetch_path(F.col("url")).alias("path"))
    keyed = u.withColumn("fetch_key", F.concat("host", "path"))
    held = keyed.where("page_id % 3 = 0").select("fetch_key").distinct()
    first = keyed.groupBy("fetch_key", "host").agg(F.min("page_id").alias("first_page")).join(held, "fetch_key", "left_anti")
    registry = spark.createDataFrame([(d,) for d in REGISTRY], "site string")
    return urls.matched_sites(first, registry).select("fetch_key", "first_page", "site")
