"""The registered queries of the numbered operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import blocklabels, bpe, divergence, exact, fingerprints, interactions, language, minhash, packing, repeats, scoring, urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    return repeats.without_repeated_bytes(documents(spark, sf_dir))


def held_out(doc_id: Column) -> Column:
    """Whether a document is not to be learned from: crc32 of its id as text leaves 2, or it has no id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; und without a letter.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id")))
    model = language.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    return language.identify(docs, model, carry=["held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the byte-level vocabulary, and what they decode to.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    import public_tokenizers

    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited one, and their likenesses.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that stand elsewhere too.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    return repeats.without_repeated_words(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: of the longest rule, else of the trees.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stupid-backoff score of every document under the counts of all.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    return scoring.score(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is a table of the session's catalog, one for each application; a run begins with an empty one."""
    index = exact.DigestIndex(spark, "op9_digest_index_" + re.sub(r"\W", "_", spark.sparkContext.applicationId))
    index.drop()
    return exact.dedup(documents(spark, sf_dir), index)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot.  Null, empty and repeated rows as in the operator's docstring; an empty table gives no rows."""
    return packing.pack(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all pairs of sources of a language, and each source's own terms, over all documents."""
    return divergence.audit(documents(spark, sf_dir))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return blocklabels.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, counted for each source, order and step."""
    return interactions.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language, op3_minhash, op4_bpe, op5_fingerprints, op6_substring_dedup, op7_url_filter, op8_lm_scores, op9_exact_dedup, op10_packing, op11_source_divergence, op12_main_text, op13_filter_interactions)}

ORACLE = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op11_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        w AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
        p AS (SELECT w.lang, w.source, k.term, coalesce(c.n, 0) AS times, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (w.n + v.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v))::BIGINT AS q
              FROM w JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = w.lang AND c.source = w.source AND c.term = k.term),
        x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE times > 0 AND p > q),
        r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
              UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_filter_interactions": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS x,
                     coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN c THEN 4 ELSE 0 END + CASE WHEN x THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS fails,
                     count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        v AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(c, bit)),
        o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS way FROM v a, v b, v c, v d, v e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, way[k] AS bit, coalesce(list_sum(way[1:k - 1]), 0)::BIGINT AS earlier FROM o, range(1, 6) AS r(k)),
        r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & earlier = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN fails & earlier > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN fails & earlier = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & earlier = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r""",
}
