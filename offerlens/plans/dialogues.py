"""Dialogue state over all conversations, in batch and as a stream; the SQL is the fold itself, as a recursive query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import dialogue
from offerlens.plans import query, shared_folder, table
from offerlens.streaming import dialogue as streamed

EXPIRY = 2

# the first user turns of a conversation say one of nine things each; amounts and banks follow the numbers of the turn
DIALOGUE_SQL = f"""
    WITH RECURSIVE u AS (SELECT conv_id, turn, length(text) % 9 AS k, s_name, (conv_id % 50 + 1) * 1000.0::DOUBLE AS sum FROM conversations JOIN supplier ON s_suppkey = (conv_id + turn) % 10 + 1 WHERE role = 'user'),
    t AS (SELECT conv_id, turn, CASE k WHEN 5 THEN 'corpus' WHEN 6 THEN 'neutral' ELSE 'plain' END AS kind, CASE WHEN k = 1 THEN s_name END AS bank, CASE k WHEN 2 THEN 'home' WHEN 5 THEN 'car' END AS product, CASE WHEN k = 8 THEN 'akaryakit' END AS topic,
          CASE k WHEN 3 THEN 'rate' WHEN 4 THEN 'term' WHEN 7 THEN 'term' END AS criterion, CASE WHEN k IN (3, 5) THEN 'least' END AS direction, CASE WHEN k IN (7, 8) THEN sum END AS amount, CASE WHEN k = 7 THEN 36 END AS months FROM u),
    l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t WHERE kind <> 'neutral'),
    f AS (
        SELECT conv_id, 0::BIGINT AS turn, 0::BIGINT AS n, '' AS kind, NULL::VARCHAR AS bank, 0::BIGINT AS bank_n, NULL::VARCHAR AS product, 0::BIGINT AS product_n, NULL::VARCHAR AS topic, 0::BIGINT AS topic_n, NULL::VARCHAR AS criterion, 0::BIGINT AS criterion_n,
               NULL::VARCHAR AS direction, 0::BIGINT AS direction_n, NULL::DOUBLE AS amount, 0::BIGINT AS amount_n, NULL::INTEGER AS months, 0::BIGINT AS months_n, ''::VARCHAR AS carried FROM (SELECT DISTINCT conv_id FROM l)
        UNION ALL
        SELECT conv_id, turn, n, kind, CASE WHEN cb THEN b ELSE bank END, CASE WHEN cb THEN bn ELSE n END, CASE WHEN cp THEN p ELSE product END, CASE WHEN cp THEN pn ELSE n END, CASE WHEN ct THEN o ELSE topic END, CASE WHEN ct THEN tn ELSE n END,
               CASE WHEN cc THEN c ELSE criterion END, CASE WHEN cc THEN cn ELSE n END, CASE WHEN cd THEN d ELSE direction END, CASE WHEN cd THEN dn ELSE n END, CASE WHEN ca THEN a ELSE amount END, CASE WHEN ca THEN an ELSE n END, CASE WHEN cm THEN m ELSE months END, CASE WHEN cm THEN mn ELSE n END,
               concat_ws(' · ', CASE WHEN cb THEN 'bank: ' || b END, CASE WHEN cp THEN 'product: ' || p END, CASE WHEN ct THEN 'topic: ' || o END, CASE WHEN cc THEN 'criterion: ' || c END, CASE WHEN cd THEN 'direction: ' || d END,
                         CASE WHEN ca THEN 'amount: ' || a::BIGINT END, CASE WHEN cm THEN 'months: ' || m END)
        FROM (SELECT l.*, f.bank AS b, f.bank_n AS bn, f.product AS p, f.product_n AS pn, f.topic AS o, f.topic_n AS tn, f.criterion AS c, f.criterion_n AS cn, f.direction AS d, f.direction_n AS dn, f.amount AS a, f.amount_n AS an, f.months AS m, f.months_n AS mn,
                     l.kind = 'plain' AND l.bank IS NULL AND f.bank IS NOT NULL AND l.n - f.bank_n <= {EXPIRY} AS cb, l.kind = 'plain' AND l.product IS NULL AND f.product IS NOT NULL AND l.n - f.product_n <= {EXPIRY} AS cp,
                     l.kind = 'plain' AND l.topic IS NULL AND l.product IS NULL AND f.topic IS NOT NULL AND l.n - f.topic_n <= {EXPIRY} AS ct, l.kind = 'plain' AND l.criterion IS NULL AND f.criterion IS NOT NULL AND l.n - f.criterion_n <= {EXPIRY} AS cc,
                     l.kind = 'plain' AND l.direction IS NULL AND f.direction IS NOT NULL AND l.n - f.direction_n <= {EXPIRY} AND l.criterion IS NULL AND f.criterion IS NOT NULL AND l.n - f.criterion_n <= {EXPIRY} AS cd,
                     l.kind = 'plain' AND l.amount IS NULL AND f.amount IS NOT NULL AND f.months IS NOT NULL AND l.n - f.amount_n <= {EXPIRY} AS ca, l.kind = 'plain' AND l.months IS NULL AND f.months IS NOT NULL AND f.amount IS NOT NULL AND l.n - f.months_n <= {EXPIRY} AS cm
              FROM f JOIN l ON l.conv_id = f.conv_id AND l.n = f.n + 1))
    SELECT conv_id, turn, kind, bank, product, topic, criterion, direction, amount, months, carried AS declared FROM f WHERE n > 0
    UNION ALL SELECT conv_id, turn, kind, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '' FROM t WHERE kind = 'neutral'"""


def said(turns: DataFrame, banks: DataFrame) -> DataFrame:
    """conv_id, turn, kind and stated slots of the user's turns, whose questions are made from the length of each text."""
    k, bank = F.pmod(F.length("text"), F.lit(9)), F.col("s_name")
    lira = F.concat(F.format_string("%d.000", (F.pmod("conv_id", F.lit(50)) + 1).cast("int")), F.lit(" TL"))
    phrases = ["Peki ya sonra?", F.concat(bank, F.lit(" ne sunuyor?")), "Konut finansmanı olsun", "En düşük kâr payı oranı", "Vade ne kadar olur?", "Hangi bankalar en ucuz taşıt finansmanını sunuyor?", "Murabaha nedir?", F.concat(lira, F.lit(" ve 36 ay vade ile")), F.concat(F.lit("Akaryakıt kampanyası "), lira)]
    question = F.lit(None).cast("string")
    for i, p in enumerate(phrases):
        question = F.when(k == i, F.lit(p) if isinstance(p, str) else p).otherwise(question)
    asked = turns.where("role = 'user'").join(banks, F.col("s_suppkey") == F.pmod(F.col("conv_id") + F.col("turn"), F.lit(10)) + 1)
    return asked.select("conv_id", "turn", question.alias("question"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")


@query(DIALOGUE_SQL)
def dialogue_state(spark, sf_dir):
    """The slots of every user turn, inherited ones declared, by windows."""
    banks = suppliers(spark, sf_dir)
    turns = dialogue.stated(said(table(spark, sf_dir, "conversations"), banks), banks.select(F.col("s_name").alias("bank")))
    return dialogue.resolved(turns, EXPIRY)


@query(DIALOGUE_SQL)
def dialogue_stream(spark, sf_dir):
    """The same as a stream whose state is each conversation's slots, run to its end; what turns state is read from them in batch."""
    at = f"{shared_folder(spark)}/dialogue-{uuid.uuid4().hex}"
    banks = suppliers(spark, sf_dir)
    dialogue.stated(said(table(spark, sf_dir, "conversations"), banks), banks.select(F.col("s_name").alias("bank"))).write.parquet(f"{at}/turns")
    rows = spark.readStream.schema(spark.read.parquet(f"{at}/turns").schema).parquet(f"{at}/turns")
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(store, streamed.STORE)
    try:
        streamed.stream_resolved(rows, EXPIRY).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{at}/out")
