"""Queries over tables laid out as text, glossaries, spellings and quotes, and the answers that compare banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.operators import tables
from offerlens.plans import ORACLE, query, table
from offerlens.plans.composed import LINES_SQL, lines
from offerlens.plans.offers import OFFERS_SQL, SCENARIO, offers


@query(LINES_SQL + "SELECT id, CASE WHEN n = 7 THEN NULL WHEN n % 3 = 0 THEN 'Vade' WHEN n % 3 = 1 THEN 'Kâr Payı Oranı' ELSE 'Tahsis Ücreti' END AS owner FROM lines")
def cell_owners(spark, sf_dir):
    """Under which heading a figure in the second row of each line's table stands; every seventh text is no table."""
    body = F.format_string("Oranlar: Vade | Kâr Payı Oranı | Tahsis Ücreti |---|---|---| 3 | 4,20%% | 0,50%% | %d Ay | %d,5%% | %d%% |", "q", "d", "t")
    words = F.when(F.col("n") == 7, F.format_string("Vade %d ay, oran %d,5, ücret %d", "q", "d", "t")).otherwise(F.replace(body, F.lit("Oranlar: "), F.lit("")))
    second = F.length(F.substring_index(words, "0,50% |", 1)) + F.length(F.lit("0,50% | "))
    widths = [F.length(F.format_string("%d Ay | ", "q")), F.length(F.format_string("%d,5%% | ", "d"))]
    k = F.col("n") % 3
    start = F.when(F.col("n") == 7, 5).when(k == 0, second).when(k == 1, second + widths[0]).otherwise(second + widths[0] + widths[1])
    return lines(spark, sf_dir).select("id", tables.column_owner(words, start).alias("owner"))


@query(LINES_SQL + """SELECT id, CASE WHEN n < 6 THEN 6 + length(CAST(q AS VARCHAR)) END AS start, CASE WHEN n < 6 THEN p || '  TL (' || d || '.)' END AS expression FROM lines""")
def spaceless_quotes(spark, sf_dir):
    """Where each line's quote stands whose blanks differ from the text's; the last ones quote what is not there."""
    body = F.concat(F.format_string("Ay %d - ", "q"), F.col("p"), F.lit("  TL ("), F.col("d"), F.lit(".) verilir."))
    quote = F.concat(F.col("p"), F.when(F.col("n") < 6, " T L(").otherwise(" USD ("), F.col("d"), F.lit(". )"))
    return lines(spark, sf_dir).select("id", tables.spaceless(body, quote).alias("s")).select("id", "s.start", "s.expression")


@query("SELECT c_custkey, nfc_normalize(c_name || ' u' || chr(776) || 'cret c' || chr(807)) AS text FROM customer")
def composed_letters(spark, sf_dir):
    """Names with letters whose marks stand apart, and blanks too many."""
    apart = F.concat("c_name", F.lit("   ücret  ç "))
    return table(spark, sf_dir, "customer").select("c_custkey", tables.tidy_composed(apart).alias("text"))


@query("""WITH w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS t FROM part),
    e AS (SELECT id, unnest(string_split(t, ' ')) AS raw, unnest(range(len(string_split(t, ' ')))) AS pos FROM w)
    SELECT lower(raw) AS word, arg_min(raw, id * 1000 + pos) AS shown FROM e WHERE raw <> '' GROUP BY 1""")
def display_forms(spark, sf_dir):
    """The words of the parts' names, a third of which are in capitals, as they are first spelled."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return tables.display_forms(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "p_partkey", "name")


@query("SELECT n_name || ' / ' || n_name || ' ' || n_regionkey AS name, unnest([lower(n_name), lower(n_name) || ' ' || n_regionkey]) AS key, 'nation ' || n_nationkey AS meaning, CASE WHEN n_nationkey % 2 = 0 THEN 'n_' || n_nationkey END AS code FROM nation")
def glossary_terms(spark, sf_dir):
    """The terms of a glossary that has a table row for each nation, under a head and a rule."""
    n = table(spark, sf_dir, "nation")
    code = F.when(F.col("n_nationkey") % 2 == 0, F.format_string("field `n_%d`", "n_nationkey")).otherwise("-")
    rows = n.select(F.concat(F.lit("| **"), "n_name", F.lit(" / "), "n_name", F.lit(" "), "n_regionkey", F.lit("** | nation "), "n_nationkey", F.lit(" | "), code, F.lit(" |")).alias("value"))
    other = spark.createDataFrame([("| Term | Meaning | Field |",), ("|---|---|---|",), ("Some prose.",), ("",)], "value string")
    return tables.glossary(rows.unionByName(other))


@query("SELECT 's' || s_suppkey || '.example.com' AS host, s_name AS bank FROM supplier UNION ALL SELECT 'shared.example.org', min(s_name) FROM supplier HAVING count(*) > 0")
def site_dimension(spark, sf_dir):
    """The hosts of a registry in which every bank has a site of its own and one that all share."""
    own = F.format_string("https://www.S%d.example.com/tr?x=1", "s_suppkey")
    return tables.site_dimension(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("bank"), F.array(own, F.lit("http://shared.example.org")).alias("sites")))


@query(OFFERS_SQL + """SELECT offer_id, field, value, unit FROM offers, LATERAL (VALUES ('amount_max', CAST(amount_max AS DOUBLE), 'lira'), ('term_months', CAST(term_months AS DOUBLE), 'month'), ('fee', CAST(fee AS DOUBLE), fee_unit), ('reward', CAST(reward AS DOUBLE), 'lira')) t(field, value, unit)
    WHERE rate IS NULL AND value IS NOT NULL""")
def known_fields(spark, sf_dir):
    return tables.known_fields(offers(spark, sf_dir))


@query(LINES_SQL + "SELECT 2 * count(*) AS cells, count(*) FILTER (WHERE n = 2) AS without_quote, count(*) FILTER (WHERE n = 3) AS misplaced, count(*) FILTER (WHERE n = 4) AS without_unit, count(*) FILTER (WHERE n = 5) AS shared_places FROM (SELECT DISTINCT ON (id) * FROM lines)")
def contract_counters(spark, sf_dir):
    """Breaches of the contract of cells, one of a kind in the lines of each of four numbers."""
    n, rows = F.col("n"), lines(spark, sf_dir).dropDuplicates(["id"])
    texts = rows.select(F.col("id").alias("doc"), F.format_string("oran %d, vade %d", "d", "q").alias("text"))
    at = F.length(F.format_string("oran %d, vade ", "d"))
    rate = F.struct(F.lit("rate").alias("field"), F.col("d").cast("double").alias("value"), F.lit("percent").alias("unit"), F.lit(5).alias("start"), F.col("d").cast("string").alias("quote"))
    term = F.struct(
        F.lit("term").alias("field"), F.col("q").cast("double").alias("value"), F.when(n != 4, "month").alias("unit"), F.when(n == 5, 5).otherwise(at).alias("start"),
        F.when(n == 2, None).when(n == 3, "on iki").when(n == 5, F.col("d").cast("string")).otherwise(F.col("q").cast("string")).alias("quote"),
    )
    return tables.contract_counters(rows.select(F.col("id").alias("doc"), F.inline(F.array(rate, term))), texts)


@query(OFFERS_SQL + f""", won AS ({ORACLE["criterion_winners"]}), scored AS (SELECT o.kind, o.bank, o.offer_id, s.score FROM offers o JOIN ({ORACLE["advantage_score"]}) s ON o.offer_id = s.offer_id)
    SELECT kind, criterion AS line, bank, value, rival_value FROM won UNION ALL SELECT kind, 'overall', bank, score, NULL FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, offer_id) AS n FROM scored) WHERE n = 1
    UNION ALL SELECT kind, 'fee_free', min(bank), CAST(count(DISTINCT bank) AS DOUBLE), NULL FROM offers WHERE fee_free GROUP BY kind""")
def comparison_answer(spark, sf_dir):
    got = tables.comparison(offers(spark, sf_dir), SCENARIO)
    return got.withColumns({c: F.col(c) + 0.0 for c in ("value", "rival_value")})
