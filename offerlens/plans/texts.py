"""Queries over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import text, urls
from offerlens.operators import records, texts
from offerlens.plans import fixed, query, table

#: DuckDB form of text.search_key.
KEY = "trim(regexp_replace(translate(lower(translate(text, 'IİŞĞÜÖÇ', 'ıişğüöç')), 'âîûışğüöç''’ʼ´`', 'aiuisguoc'), '\\s+', ' ', 'g'))"
WORDS = f"list_filter(string_split_regex({KEY}, '[^0-9a-z]+'), lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '\\d+'))"


@query(f"SELECT doc_id, sha256({KEY}) AS key_sha256 FROM documents")
def search_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.search_key(F.col("text")), 256).alias("key_sha256"))


@query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, sha256(array_to_string(w, ' ')) AS words_sha256 FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def topic_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.topic_words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("words_sha256"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, c[i] AS chunk FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: trim(x)), lambda x: length(x) >= 40) AS c FROM documents), LATERAL (SELECT unnest(generate_series(1, len(c))) AS i)")
def chunk_paragraphs(spark, sf_dir):
    return texts.chunks(table(spark, sf_dir, "documents"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\\n+'), lambda x: length(trim(x)) >= 40)) = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unindexable_pages(spark, sf_dir):
    """Pages that a purge would delete: no line worth indexing, and not protected."""
    held = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where(F.size(text.paragraphs(F.col("text"))) == 0).join(held, "doc_id", "left_anti").select("doc_id")


@query("""WITH d AS (SELECT doc_id AS id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS h, length(text) AS n, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS held FROM documents)
    SELECT id, first_value(id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d WINDOW w AS (PARTITION BY h ORDER BY NOT held, n, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def content_dedupe_survivor(spark, sf_dir):
    held = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("held")).distinct()
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.content_hash(F.col("text")).alias("h"), F.length("text").alias("n")).join(held, "id", "left")
    return records.survivors(d, "h", [~F.coalesce("held", F.lit(False)), F.col("n"), F.col("id")]).select("id", "keep_id", "group_size")


@query("SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)")
def evidence_containment(spark, sf_dir):
    return texts.containments(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("""WITH hits AS (SELECT doc_id, kind, unnest(v) AS value FROM (
      SELECT doc_id, 'email' AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS v FROM documents))
    SELECT doc_id, kind, '***@' || regexp_extract(value, '@(.+)$', 1) AS masked, count(*) AS hits FROM hits GROUP BY ALL""")
def pii_emails(spark, sf_dir):
    return texts.personal_data(table(spark, sf_dir, "documents")).where("kind = 'email'")


@query()
def pii_scan(spark, sf_dir):
    return texts.personal_data(table(spark, sf_dir, "documents"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(text, '([-+]?\\d[\\d.,\\s]*\\d|\\d)', 1), '\\s+', '', 'g'), '^[-+]', '') AS body, regexp_extract(text, '([-+]?\\d[\\d.,\\s]*\\d|\\d)', 1) AS raw FROM documents),
    p AS (SELECT doc_id, raw, CASE WHEN contains(body, '.') AND (contains(body, ',') OR regexp_matches(body, '\\.\\d{3}$')) THEN replace(body, '.', '') ELSE body END AS body FROM d)
    SELECT doc_id, CASE WHEN raw LIKE '-%' THEN -1 ELSE 1 END * TRY_CAST(NULLIF(replace(body, ',', '.'), '') AS DOUBLE) AS number FROM p""")
def number_parse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.number(F.col("text")).alias("number"))


NORMAL = """'https://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
    || (CASE WHEN len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) > 0
        THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') ELSE '' END)"""


@query(f"SELECT page_id, {NORMAL} AS normal FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normal"))


@query(f"""WITH n AS (SELECT page_id, {NORMAL} AS normal FROM pages), found AS (SELECT DISTINCT normal FROM n WHERE page_id % 3 <> 0), listed AS (SELECT DISTINCT normal FROM n WHERE page_id % 3 <> 1)
    SELECT normal, 'new' AS change FROM (SELECT * FROM found EXCEPT SELECT * FROM listed) UNION ALL SELECT normal, 'removed' FROM (SELECT * FROM listed EXCEPT SELECT * FROM found)""")
def url_discovery_diff(spark, sf_dir):
    """What a discovery run reports against the run before; two thirds of the pages stand for each run."""
    n = table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normal"))
    side = lambda rest: n.where(f"page_id % 3 <> {rest}").select("normal").distinct()
    found, listed = side(0), side(1)
    return found.join(listed, "normal", "left_anti").select("normal", F.lit("new").alias("change")).unionByName(listed.join(found, "normal", "left_anti").select("normal", F.lit("removed").alias("change")))


@query()
def html_body(spark, sf_dir):
    """Bodies of at least 200 characters; shorter ones are not kept."""
    return texts.bodies(table(spark, sf_dir, "pages")).where(F.length("body") >= 200)


VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]


@query(f"SELECT vec_id, CAST(row_number() OVER (ORDER BY list_cosine_similarity(embedding, {VECTOR}) DESC, vec_id) AS INTEGER) AS rank FROM embeddings ORDER BY rank LIMIT 15")
def vector_topk(spark, sf_dir):
    return texts.nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 15).select("vec_id", "rank")


@query(f"SELECT vec_id, CAST(row_number() OVER (ORDER BY list_cosine_similarity(embedding, {VECTOR}) DESC, vec_id) AS INTEGER) AS rank FROM embeddings WHERE label = 3 ORDER BY rank LIMIT 15")
def vector_topk_filtered(spark, sf_dir):
    return texts.nearest(table(spark, sf_dir, "embeddings").where("label = 3"), query_vector(spark, sf_dir), 15).select("vec_id", "rank")


@query(f"WITH s AS (SELECT vec_id, label, list_cosine_similarity(embedding, {VECTOR}) AS c FROM embeddings), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS n FROM s) SELECT vec_id, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM b WHERE n = 1 ORDER BY rank LIMIT 3")
def vector_topk_diverse(spark, sf_dir):
    return texts.nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 3, signature=F.col("label")).select("vec_id", "rank")


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS word FROM documents) SELECT word, count(*) AS df, floor((ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / count(*))) * 1e6 + 0.5) / 1e6 AS weight FROM w GROUP BY word")
def topic_idf_weights(spark, sf_dir):
    return texts.word_weights(table(spark, sf_dir, "documents")).withColumn("weight", fixed("weight", 6))


ASKED = ["thionand", "tionthe", "erthe", "anwhich", "verein", "queiaux"]


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS word FROM documents), a AS (SELECT unnest({ASKED}) AS asked),
    h AS (SELECT DISTINCT doc_id, asked FROM w JOIN a ON left(word, 4) = left(asked, 4) WHERE (least(length(word), length(asked)) >= 5 AND left(word, 5) = left(asked, 5)) OR least(length(word), length(asked)) = 4),
    f AS (SELECT asked, ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / count(*)) AS weight FROM h GROUP BY asked HAVING count(*) <= 0.03 * (SELECT count(*) FROM documents))
    SELECT doc_id, floor((sum(weight)) * 1e6 + 0.5) / 1e6 AS score FROM h JOIN f USING (asked) GROUP BY doc_id""")
def topic_match(spark, sf_dir):
    return texts.topic_matches(table(spark, sf_dir, "documents"), ASKED).withColumn("score", fixed("score", 6))
