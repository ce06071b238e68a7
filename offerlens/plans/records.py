"""Queries over orders, events, labels and conversations: statistics, evaluation, dialogue, monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.functions import text
from offerlens.operators import audit, records
from offerlens.plans import fixed, query, shared_folder, table
from offerlens.streaming import freshness


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scan_filter_equality(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest_wins(spark, sf_dir):
    return records.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT event_type, max(event_id) AS run_id, arg_max(ts, event_id) AS ts, count(*) AS runs FROM events GROUP BY event_type")
def run_log_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("event_id").alias("run_id"), F.max_by("ts", "event_id").alias("ts"), F.count(F.lit(1)).alias("runs"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS latest, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total FROM orders GROUP BY ALL")
def overview_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.max("o_orderdate").alias("latest"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))


@query("""WITH g AS (SELECT n_name AS nation, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT nation, n, customers, floor((100.0 * n / (SELECT sum(n) FROM g)) * 1e4 + 0.5) / 1e4 AS share FROM g""")
def coverage_by_bank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    got = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return got.crossJoin(F.broadcast(got.agg(F.sum("n").alias("total")))).withColumn("share", fixed(F.lit(100.0) * F.col("n") / F.col("total"), 4)).drop("total")


STATUSES = ["F", "O", "P"]


@query("SELECT o_orderpriority AS priority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS n_{s}" for s in STATUSES) + " FROM orders GROUP BY ALL")
def type_pivot(spark, sf_dir):
    got = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", STATUSES).count()
    return got.select("priority", *[F.coalesce(s, F.lit(0)).alias(f"n_{s}") for s in STATUSES])


@query("SELECT user_id, ts, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: A prediction by fixed rules, to hold the labels against: null where the text says too little.
PREDICTED_SQL = "WITH p AS (SELECT l.doc_id, field, gold, predicted FROM labels l JOIN (SELECT DISTINCT doc_id, length(text) AS n FROM documents) d USING (doc_id), LATERAL (VALUES ('quality', CAST(l.quality AS INTEGER), CASE WHEN n > 1500 THEN 1 WHEN n > 300 THEN 0 END), ('toxic', CASE WHEN l.toxic = 1 THEN 1 END, CASE WHEN n % 7 = 0 THEN 1 END)) t(field, gold, predicted))"
RATIOS = "tp, fp, fn, \"right\", n, floor((CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp + fp > 0 THEN tp * 1.0::DOUBLE / (tp + fp) ELSE 0 END END) * 1e6 + 0.5) / 1e6 AS precision, floor((CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp + fn > 0 THEN tp * 1.0::DOUBLE / (tp + fn) ELSE 0 END END) * 1e6 + 0.5) / 1e6 AS recall, floor((CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) * 1e6 + 0.5) / 1e6 AS f1"
COUNTS_SQL = PREDICTED_SQL + ", c AS (SELECT field, count(*) FILTER (WHERE gold IS NOT NULL AND gold IS NOT DISTINCT FROM predicted) AS tp, count(*) FILTER (WHERE predicted IS NOT NULL AND gold IS DISTINCT FROM predicted) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND gold IS DISTINCT FROM predicted) AS fn, count(*) FILTER (WHERE gold IS NOT DISTINCT FROM predicted) AS \"right\", count(*) AS n FROM p GROUP BY field)"


def predicted(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).distinct()
    rows = table(spark, sf_dir, "labels").join(n, "doc_id")
    quality = F.when(F.col("n") > 1500, 1).when(F.col("n") > 300, 0)
    return rows.select("doc_id", F.inline(F.array(
        F.struct(F.lit("quality").alias("field"), F.col("quality").cast("int").alias("gold"), quality.alias("predicted")),
        F.struct(F.lit("toxic").alias("field"), F.when(F.col("toxic") == 1, 1).alias("gold"), F.when(F.col("n") % 7 == 0, 1).alias("predicted")),
    )))


@query(COUNTS_SQL + f" SELECT field, {RATIOS} FROM c")
def slot_f1(spark, sf_dir):
    got = records.confusion(predicted(spark, sf_dir))
    return got.select("field", "tp", "fp", "fn", "right", "n", *[fixed(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(COUNTS_SQL + ", f AS (SELECT tp, fp, fn, \"right\", n, CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c) SELECT floor((avg(f1)) * 1e6 + 0.5) / 1e6 AS macro_f1, floor((sum(\"right\") * 1.0::DOUBLE / sum(n)) * 1e6 + 0.5) / 1e6 AS accuracy, avg(f1) >= 0.78 AS reached FROM f")
def macro_f1(spark, sf_dir):
    got = records.confusion(predicted(spark, sf_dir)).agg(F.avg("f1").alias("m"), (F.sum("right") / F.sum("n")).alias("a"))
    return got.select(fixed("m", 6).alias("macro_f1"), fixed("a", 6).alias("accuracy"), (F.col("m") >= 0.78).alias("reached"))


REPLICATES = 400


@query(PREDICTED_SQL + f""", d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS total FROM (SELECT doc_id, count(*) FILTER (WHERE gold IS NOT NULL AND gold IS NOT DISTINCT FROM predicted) AS tp, count(*) FILTER (WHERE predicted IS NOT NULL AND gold IS DISTINCT FROM predicted) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND gold IS DISTINCT FROM predicted) AS fn FROM p GROUP BY doc_id)),
    draws AS (SELECT rep, CAST('0x' || substr(md5(rep || ':' || place), 1, 8) AS BIGINT) % total AS place FROM d, (SELECT unnest(range({REPLICATES})) AS rep)),
    f AS (SELECT rep, 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM draws JOIN d USING (place) GROUP BY rep), s AS (SELECT f1, row_number() OVER (ORDER BY f1) - 1 AS k FROM f)
    SELECT floor((max(f1) FILTER (WHERE k = 10)) * 1e6 + 0.5) / 1e6 AS low, floor((max(f1) FILTER (WHERE k = 390)) * 1e6 + 0.5) / 1e6 AS high FROM s""")
def bootstrap_ci(spark, sf_dir):
    """A 95 % interval of the pooled F1 over resampled documents; draws are by hash, so the interval is the same at every run.

    The draws, so many times the labelled documents, are made in as many tasks as shuffles have.
    """
    g, p = F.col("gold"), F.col("predicted")
    d = predicted(spark, sf_dir).groupBy("doc_id").agg(F.count_if(g.isNotNull() & g.eqNullSafe(p)).alias("tp"), F.count_if(p.isNotNull() & ~g.eqNullSafe(p)).alias("fp"), F.count_if(g.isNotNull() & ~g.eqNullSafe(p)).alias("fn"))
    place = audit.placed(d.select(F.col("doc_id").alias("id")))
    d = d.join(place, F.col("doc_id") == F.col("id"))
    total = place.agg(F.count(F.lit(1)).alias("total"))
    dealt = place.select("place").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "place")
    draws = dealt.crossJoin(F.broadcast(total)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    drawn = draws.select("rep", (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("place").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("total")).cast("int").alias("place"))
    # Spark takes exploded rows for as few as they come from, and would broadcast the draws: the documents' side is hashed instead
    f = drawn.join(d.hint("shuffle_hash"), "place").groupBy("rep").agg((2.0 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("f1"))
    ordered = f.agg(F.array_sort(F.collect_list("f1")).alias("s"))  # one value a replicate
    at = lambda k, name: fixed(F.get("s", F.lit(k)), 6).alias(name)
    return ordered.select(at(int(REPLICATES * 0.025), "low"), at(int(REPLICATES * 0.975), "high"))


ANNOTATED_SQL = "WITH a AS (SELECT doc_id AS id, field, who, value FROM labels, LATERAL (VALUES ('quality', 'ann', quality), ('quality', 'bo', CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END), ('quality', 'cy', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END), ('toxic', 'ann', toxic), ('toxic', 'bo', toxic), ('toxic', 'cy', CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END)) t(field, who, value))"
PAIRS_SQL = ANNOTATED_SQL + ", g AS (SELECT x.field, x.who AS a, y.who AS b, count(*) AS n, count(*) FILTER (WHERE x.value IS NOT DISTINCT FROM y.value) AS same, count(*) FILTER (WHERE x.value IS NOT NULL OR y.value IS NOT NULL) AS filled, count(*) FILTER (WHERE x.value IS NOT DISTINCT FROM y.value AND x.value IS NOT NULL) AS same_filled FROM a x JOIN a y ON x.id = y.id AND x.field = y.field AND x.who < y.who GROUP BY ALL)"


def annotated(spark, sf_dir):
    q, t, i = F.col("quality"), F.col("toxic"), F.col("doc_id")
    cells = [("quality", "ann", q), ("quality", "bo", F.when(i % 5 == 0, 1 - q).otherwise(q)), ("quality", "cy", F.when(i % 3 != 0, q)), ("toxic", "ann", t), ("toxic", "bo", t), ("toxic", "cy", F.when(i % 11 == 0, 1 - t).otherwise(t))]
    return table(spark, sf_dir, "labels").select(i.alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("who"), v.alias("value")) for f, w, v in cells])))


@query(PAIRS_SQL + " SELECT field, a, b, n, same, filled, same_filled FROM g")
def annotator_agreement(spark, sf_dir):
    return records.agreement(annotated(spark, sf_dir))


@query(ANNOTATED_SQL + ", v AS (SELECT id, field, value, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT id, field, count(*) AS total FROM a GROUP BY ALL) SELECT id, field, value, n, total FROM v JOIN t USING (id, field) WHERE n * 2 > total")
def majority_vote(spark, sf_dir):
    return records.majority(annotated(spark, sf_dir))


@query(PAIRS_SQL + " SELECT a, b, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(same_filled) AS BIGINT) AS same_filled FROM (SELECT * FROM g WHERE field = 'toxic') GROUP BY a, b HAVING sum(filled) >= 10 AND sum(filled) = sum(same_filled)")
def copy_suspicion(spark, sf_dir):
    return records.copied(annotated(spark, sf_dir).where("field = 'toxic'"))


@query("""WITH s AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS round, count(*) OVER (PARTITION BY lang) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT doc_id, lang, source, CAST(round AS INTEGER) AS round FROM s ORDER BY round, size, lang, source, md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50""")
def stratified_sample(spark, sf_dir):
    """Fifty unlabelled documents, round by round over languages (rare ones first) and sources."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    size = d.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    h = F.md5(F.col("doc_id").cast("string"))
    first = d.withColumn("round", F.row_number().over(W.partitionBy("lang", "source").orderBy(h, "doc_id"))).where("round <= 50")
    return first.join(size, "lang").orderBy("round", "size", "lang", "source", h, "doc_id").limit(50).select("doc_id", "lang", "source", "round")


@query("""WITH sheets AS (SELECT doc_id AS id, 'consensus' AS sheet, 0 AS priority, quality AS value FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'ann', 1, 1 - quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'bo', 2, quality FROM labels)
    SELECT id, sheet, value FROM sheets QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority) = 1""")
def gold_compile(spark, sf_dir):
    """One label for each id: consensus first, then the personal sheets in order."""
    q, part = table(spark, sf_dir, "labels"), lambda rows, sheet, n, v: rows.select(F.col("doc_id").alias("id"), F.lit(sheet).alias("sheet"), F.lit(n).alias("priority"), v.alias("value"))
    sheets = part(q.where("doc_id % 4 = 0"), "consensus", 0, F.col("quality")).unionByName(part(q.where("doc_id % 2 = 0"), "ann", 1, 1 - F.col("quality"))).unionByName(part(q, "bo", 2, F.col("quality")))
    return sheets.groupBy("id").agg(F.min_by(F.struct("sheet", "value"), "priority").alias("r")).select("id", "r.*")


@query("""WITH x AS (SELECT doc_id, quality AS a FROM labels WHERE doc_id % 3 <> 0), y AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS b FROM labels WHERE doc_id % 3 <> 1)
    SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, CASE WHEN x.doc_id IS NULL THEN 'adds' WHEN y.doc_id IS NULL THEN 'removes' WHEN a = b THEN 'same' ELSE 'differs' END AS change FROM x FULL JOIN y ON x.doc_id = y.doc_id""")
def round2_diff(spark, sf_dir):
    q = table(spark, sf_dir, "labels")
    x, y = q.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("a")), q.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b"))
    return x.join(y, "doc_id", "full").select("doc_id", F.when(F.col("a").isNull(), "adds").when(F.col("b").isNull(), "removes").when(F.col("a") == F.col("b"), "same").otherwise("differs").alias("change"))


SENTENCES = "list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 30 AND 260 AND contains(lower(x), 'tion'))"


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS place, s[i] AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), LATERAL (SELECT unnest(generate_series(1, least(3, len(s)))) AS i)")
def relevant_sentences(spark, sf_dir):
    """Up to three sentences of a document that hold a keyword: three are what a labeller is shown."""
    s = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x)), lambda x: F.length(x).between(30, 260) & F.lower(x).contains("tion"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(s, 1, 3)).alias("place", "sentence")).withColumn("place", F.col("place") + 1)


@query("""SELECT conv_id, turn, last_value(slot IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot, slot IS NULL AS carried
    FROM (SELECT *, NULLIF(regexp_extract(text, '([A-ZÄÖÜÉÈ][a-zäöüßéèêç]{9,})', 1), '') AS slot FROM conversations WHERE role = 'user')""")
def slot_carry_over(spark, sf_dir):
    """A long capitalised word stands for a resolved slot; turns without one carry the last over."""
    slot = F.nullif(F.regexp_extract("text", "([A-ZÄÖÜÉÈ][a-zäöüßéèêç]{9,})", 1), F.lit(""))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("s", slot).select("conv_id", "turn", F.last("s", ignorenulls=True).over(w).alias("slot"), F.col("s").isNull().alias("carried"))


@query("""WITH c AS (SELECT o_orderkey, 'order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y') || ' costs ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) || CASE WHEN o_orderkey % 10 = 0 THEN ' or 987654321' ELSE '' END AS answer, [CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y'), CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR)] AS allowed FROM orders)
    SELECT o_orderkey, CAST(len(list_filter(regexp_extract_all(answer, '\\d+'), lambda x: length(x) > 1 AND NOT list_contains(allowed, x))) AS INTEGER) AS unknown FROM c""")
def unknown_numbers(spark, sf_dir):
    """How many numbers of an answer its record does not hold; one-digit numbers are not looked at."""
    price = F.round("o_totalprice").cast("long").cast("string")
    allowed = F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy"), price)
    answer = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "yyyy"), F.lit(" costs "), price, F.when(F.col("o_orderkey") % 10 == 0, " or 987654321").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.array_except(text.numbers_in(answer), allowed)).alias("unknown"))


POLLS_SQL = "WITH p AS (SELECT 'u' || user_id AS url, event_id AS seq, ts, CASE WHEN event_type <> 'error' THEN event_type END AS digest FROM events), b AS (SELECT *, last_value(digest IGNORE NULLS) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p), s AS (SELECT *, CASE WHEN digest IS NULL THEN 'unreachable' WHEN before IS NULL THEN 'first' WHEN before = digest THEN 'unchanged' ELSE 'changed' END AS state FROM b)"
TRANSITIONS_SQL = POLLS_SQL + " SELECT url, seq, state, last_value(CASE WHEN state = 'changed' THEN ts END IGNORE NULLS) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS changed_at FROM s"


def polls(events):
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("digest"))


@query(TRANSITIONS_SQL)
def freshness_transitions(spark, sf_dir):
    return freshness.transitions(polls(table(spark, sf_dir, "events")))


@query(TRANSITIONS_SQL)
def freshness_stream(spark, sf_dir):
    """The same as a stream with state, run to its end; the result is what the sink holds."""
    at = f"{shared_folder(spark)}/freshness-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = polls(source).withColumn("ts", F.col("ts").cast("timestamp"))
    q = freshness.stream_transitions(rows).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@query("WITH s AS (SELECT event_id, ts, unnest([-1, 0, 1]) AS d FROM events), t AS (SELECT event_id, ts, date_trunc('day', ts) + to_days(CAST(d AS INTEGER)) + to_hours(h) AS slot FROM s, (SELECT unnest([0, 8, 17]) AS h)) SELECT event_id, min(slot) FILTER (WHERE slot > ts) AS next_run, max(slot) FILTER (WHERE slot <= ts) AS previous_run FROM t GROUP BY event_id")
def trigger_calendar(spark, sf_dir):
    return freshness.triggers(table(spark, sf_dir, "events"), "ts", [0, 8, 17]).select("event_id", "next_run", "previous_run")


INTENTS = [("compare", "tiontion|cheungen"), ("condition", "that|der "), ("list", "les |die "), ("definition", "of |von ")]


@query("SELECT intent, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{i}'" for i, p in INTENTS) + " ELSE 'other' END AS intent FROM conversations WHERE role = 'user') GROUP BY intent")
def finding_classes(spark, sf_dir):
    """Questions by the first cue list that matches, and how many fall to each."""
    intent = F.lit("other")
    for i, p in reversed(INTENTS):
        intent = F.when(F.lower("text").rlike(p), i).otherwise(intent)
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(intent.alias("intent")).agg(F.count(F.lit(1)).alias("n"))
