"""Offers made from the star schema, and the comparison queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import eligibility, finance, ranking, records
from offerlens.plans import fixed, query, table

TOP = 100
GRID = [3, 6, 12, 18, 24, 36, 48]
SCENARIO = ranking.Scenario(principal=50_000.0, months=24)
#: Parts of each nation's offers when they meet its profiles.
PARTS = 16
#: Profiles at most that go to every task; if there are more, they are dealt to parts of the offers.
KNOWN = 1 << 18
#: Offers and pairs of one task, at most or nearly so; the names of so many offers still fit a dictionary of a file.
TASK_OFFERS, TASK_PAIRS = 1 << 15, 1 << 24

OFFERS_SQL = """
    WITH offers AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS offer_id, s_name AS bank, n_name AS country,
               CASE p_type WHEN 'STANDARD' THEN 'home' WHEN 'MEDIUM' THEN 'vehicle' WHEN 'LARGE' THEN 'need' WHEN 'SMALL' THEN 'card' WHEN 'ECONOMY' THEN 'shopping' END AS kind,
               CASE WHEN l_linenumber <> 5 THEN l_discount * 100 END AS rate,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS amount_max,
               CASE WHEN l_linenumber <> 6 THEN CAST(l_quantity AS INTEGER) END AS term_months,
               CASE WHEN l_linenumber <> 3 THEN CASE l_returnflag WHEN 'R' THEN l_tax * 10000 ELSE l_tax * 10 END END AS fee,
               CASE WHEN l_linenumber <> 3 THEN CASE l_returnflag WHEN 'R' THEN 'lira' WHEN 'A' THEN 'percent' END END AS fee_unit,
               CASE WHEN l_linestatus = 'O' THEN l_extendedprice * l_tax END AS reward,
               CASE WHEN l_tax = 0 THEN true WHEN l_returnflag = 'N' THEN NULL ELSE false END AS fee_free,
               CAST(l_shipdate AS DATE) AS ends_on,
               ((CASE WHEN l_linenumber <> 5 THEN 1 ELSE 0 END) + (CASE WHEN l_linenumber <> 7 THEN 1 ELSE 0 END) + (CASE WHEN l_linenumber <> 6 THEN 1 ELSE 0 END)
                + (CASE WHEN l_linenumber <> 3 THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)) / 5.0::DOUBLE AS fill
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    based AS (
        SELECT *, CASE WHEN kind IN ('need', 'home', 'vehicle', 'business') THEN rate END AS rate_base,
               CASE fee_unit WHEN 'lira' THEN fee WHEN 'percent' THEN fee * 50000.0::DOUBLE / 100 END AS fee_base
        FROM offers)
"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as offers: bank is the supplier, kind comes from the part, with gaps by line number."""
    lines, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    rows = lines.join(part.select("p_partkey", "p_type"), lines.l_partkey == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_name", "s_nationkey"), lines.l_suppkey == F.col("s_suppkey")).join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    kinds = {"STANDARD": "home", "MEDIUM": "vehicle", "LARGE": "need", "SMALL": "card", "ECONOMY": "shopping"}
    kind = F.lit(None).cast("string")
    for k, v in kinds.items():
        kind = F.when(F.col("p_type") == k, v).otherwise(kind)
    n, has = F.col("l_linenumber"), lambda c: F.when(c, 1).otherwise(0)
    unit = F.when(F.col("l_returnflag") == "R", "lira").when(F.col("l_returnflag") == "A", "percent")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("offer_id"), F.col("s_name").alias("bank"), F.col("n_name").alias("country"), kind.alias("kind"),
        F.when(n != 5, F.col("l_discount") * 100).alias("rate"), F.when(n != 7, F.col("l_extendedprice")).alias("amount_max"), F.when(n != 6, F.col("l_quantity").cast("int")).alias("term_months"),
        F.when(n != 3, F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 10000).otherwise(F.col("l_tax") * 10)).alias("fee"), F.when(n != 3, unit).alias("fee_unit"),
        F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") * F.col("l_tax")).alias("reward"),
        F.when(F.col("l_tax") == 0, True).when(F.col("l_returnflag") != "N", False).alias("fee_free"), F.col("l_shipdate").cast("date").alias("ends_on"),
        ((has(n != 5) + has(n != 7) + has(n != 6) + has(n != 3) + has(F.col("l_linestatus") == "O")) / 5.0).alias("fill"),
    )


@query(OFFERS_SQL + "SELECT offer_id, kind, rate_base, fee_base, fee_unit FROM based")
def offers_common_base(spark, sf_dir):
    o = offers(spark, sf_dir)
    return o.select("offer_id", "kind", ranking.reduced("rate").alias("rate_base"), ranking.reduced("fee", SCENARIO).alias("fee_base"), "fee_unit")


def rank_sql(value: str, direction: str) -> str:
    return OFFERS_SQL + f"SELECT offer_id, bank, CAST({value} AS DOUBLE) AS value, CAST(row_number() OVER (ORDER BY {value} {direction} NULLS LAST, offer_id) AS INTEGER) AS rank FROM based ORDER BY rank LIMIT {TOP}"


def ranked(spark, sf_dir, criterion):
    return ranking.ranked(offers(spark, sf_dir), criterion, TOP, SCENARIO).select("offer_id", "bank", "value", "rank")


@query(rank_sql("rate_base", "ASC"))
def rank_lowest_rate(spark, sf_dir):
    return ranked(spark, sf_dir, "lowest_rate")


@query(rank_sql("fee_base", "ASC"))
def rank_lowest_fee(spark, sf_dir):
    return ranked(spark, sf_dir, "lowest_fee")


@query(rank_sql("term_months", "DESC"))
def rank_longest_term(spark, sf_dir):
    return ranked(spark, sf_dir, "longest_term")


@query(rank_sql("reward", "DESC"))
def rank_highest_reward(spark, sf_dir):
    return ranked(spark, sf_dir, "highest_reward")


@query(OFFERS_SQL + """,
    ends AS (SELECT min(rate_base) rl, max(rate_base) rh, min(fee_base) fl, max(fee_base) fh, min(reward) wl, max(reward) wh, min(term_months)::DOUBLE tl, max(term_months)::DOUBLE th FROM based),
    parts AS (SELECT offer_id, fee_free, rate_base, fee_base, reward, term_months,
        CASE WHEN rate_base IS NULL THEN 0.4::DOUBLE * 0.5 ELSE 0.4::DOUBLE * (CASE WHEN rh = rl THEN 1.0 ELSE (rh - rate_base) / (rh - rl) END) END AS a,
        CASE WHEN fee_base IS NULL THEN 0.25::DOUBLE * 0.5 ELSE 0.25::DOUBLE * (CASE WHEN fh = fl THEN 1.0 ELSE (fh - fee_base) / (fh - fl) END) END AS b,
        CASE WHEN coalesce(fee_free, false) AND fee_base IS NULL THEN 0.25::DOUBLE * 0.5 ELSE 0.0 END AS bonus,
        CASE WHEN reward IS NULL THEN 0.2::DOUBLE * 0.5 ELSE 0.2::DOUBLE * (CASE WHEN wh = wl THEN 1.0 ELSE (reward - wl) / (wh - wl) END) END AS c,
        CASE WHEN term_months IS NULL THEN 0.15::DOUBLE * 0.5 ELSE 0.15::DOUBLE * (CASE WHEN th = tl THEN 1.0 ELSE (term_months - tl) / (th - tl) END) END AS d
        FROM based CROSS JOIN ends)
    SELECT offer_id, floor((a + b + bonus + c + d) * 1e6 + 0.5) / 1e6 AS score,
        CAST((CASE WHEN rate_base IS NULL THEN 0 ELSE 0.40 END) + (CASE WHEN fee_base IS NULL AND NOT coalesce(fee_free, false) THEN 0 ELSE 0.25 END)
          + (CASE WHEN reward IS NULL THEN 0 ELSE 0.20 END) + (CASE WHEN term_months IS NULL THEN 0 ELSE 0.15 END) AS DOUBLE) AS comparability FROM parts""")
def advantage_score(spark, sf_dir):
    rows = ranking.advantage(offers(spark, sf_dir), scenario=SCENARIO)
    six = lambda c: fixed(F.col(c), 6).alias(c)
    return rows.select("offer_id", six("score"), six("comparability"))


@query(OFFERS_SQL + """,
    tall AS (SELECT kind, bank, offer_id, criterion, v FROM based, LATERAL (VALUES ('lowest_rate', -rate_base), ('lowest_fee', -fee_base), ('longest_term', CAST(term_months AS DOUBLE)), ('highest_reward', reward)) t(criterion, v) WHERE v IS NOT NULL),
    banks AS (SELECT *, row_number() OVER (PARTITION BY kind, criterion, bank ORDER BY v DESC, offer_id) AS n FROM tall),
    best AS (SELECT *, row_number() OVER w AS m, lead(v) OVER w AS rival FROM banks WHERE n = 1 WINDOW w AS (PARTITION BY kind, criterion ORDER BY v DESC, offer_id))
    SELECT kind, criterion, offer_id, bank, CASE WHEN criterion LIKE 'lowest%' THEN -v ELSE v END AS value, CASE WHEN criterion LIKE 'lowest%' THEN -rival ELSE rival END AS rival_value FROM best WHERE m = 1""")
def criterion_winners(spark, sf_dir):
    rows = ranking.winners(offers(spark, sf_dir), scenario=SCENARIO)
    plus = lambda c: (F.col(c) + 0.0).alias(c)  # noqa: E731  no negative zero
    return rows.select("kind", "criterion", "offer_id", "bank", plus("value"), plus("rival_value"))


@query(OFFERS_SQL + "SELECT bank, offer_id, fill FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY fill DESC, offer_id) AS n FROM offers) WHERE n = 1")
def one_best_per_bank(spark, sf_dir):
    return ranking.best_per_bank(offers(spark, sf_dir))


@query(OFFERS_SQL + """,
    g AS (SELECT bank, count(*) AS n, count(DISTINCT fee_unit) AS u, count(DISTINCT term_months) AS t, count(DISTINCT kind) AS k, count(*) FILTER (WHERE rate_base IS NULL) AS r FROM based GROUP BY bank HAVING count(*) > 1)
    SELECT bank, n, warning, blocking FROM g, LATERAL (VALUES ('unit_mix', true, u > 1), ('term_mix', false, t > 1), ('missing_rate', false, r > 0), ('kind_mix', false, k > 1)) w(warning, blocking, holds) WHERE holds""")
def comparison_warnings(spark, sf_dir):
    return ranking.warnings(offers(spark, sf_dir), "bank")


PAYMENT = "CASE WHEN {a} > 0 AND {n} > 0 AND {r} >= 0 THEN CASE WHEN {r} / 100 = 0 THEN {a} / {n} ELSE {a} * ({r} / 100) / (1 - pow(1 + {r} / 100, -CAST({n} AS DOUBLE))) END END"


@query(OFFERS_SQL + f"SELECT offer_id, floor(({PAYMENT.format(a='amount_max', r='rate', n='term_months')}) * 1e4 + 0.5) / 1e4 AS payment, floor(({PAYMENT.format(a='amount_max', r='rate', n='term_months')} * term_months) * 1e4 + 0.5) / 1e4 AS total FROM offers")
def annuity_cost(spark, sf_dir):
    a, r, n = F.col("amount_max"), F.col("rate"), F.col("term_months")
    four = lambda c: fixed(c, 4)
    return offers(spark, sf_dir).select("offer_id", four(finance.instalment(a, r, n)).alias("payment"), four(finance.cost(a, r, n)).alias("total"))


GRID_SQL = OFFERS_SQL + f""",
    grid AS (SELECT offer_id, rate, term_months, months FROM (SELECT offer_id, rate, term_months, unnest(list_distinct(list_append({GRID}, term_months))) AS months FROM offers WHERE rate IS NOT NULL AND term_months > 0) WHERE months <= term_months),
    costs AS (SELECT *, {PAYMENT.format(a='50000.0::DOUBLE', r='rate', n='months')} AS p, {PAYMENT.format(a='50000.0::DOUBLE', r='rate', n='term_months')} AS own FROM grid)
"""


@query(GRID_SQL + "SELECT offer_id, months, floor((p) * 1e4 + 0.5) / 1e4 AS payment, floor((p * months) * 1e4 + 0.5) / 1e4 AS total, floor((p * months - own * term_months) * 1e4 + 0.5) / 1e4 AS total_delta FROM costs")
def term_sensitivity(spark, sf_dir):
    rows = finance.sensitivity(offers(spark, sf_dir), SCENARIO.principal, GRID)
    return rows.select("offer_id", "months", *[fixed(F.col(c), 4).alias(c) for c in ("payment", "total", "total_delta")])


@query(GRID_SQL + ", longest AS (SELECT offer_id, max(months) AS longest FROM costs GROUP BY offer_id) SELECT offer_id, any_value(longest) AS longest, max(months) FILTER (WHERE months < longest) AS next_shorter, min(months) FILTER (WHERE p <= 2500) AS shortest_affordable FROM costs JOIN longest USING (offer_id) GROUP BY offer_id")
def term_advice(spark, sf_dir):
    return finance.advice(finance.sensitivity(offers(spark, sf_dir), SCENARIO.principal, GRID), 2500.0)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of every hundredth customer, the stated query set."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("profile_id"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("customer_type"), (F.col("c_acctbal") * 5).alias("amount"), (F.pmod("c_custkey", F.lit(48)) + 1).cast("int").alias("months"))


def conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with the conditions that profiles are held against."""
    return offers(spark, sf_dir).select("offer_id", "country", "rate", "fill", F.when(F.col("fee_unit") == "lira", F.col("fee")).alias("fee_lira"), F.when(F.col("kind") == "card", "HOUSEHOLD").when(F.col("kind") == "vehicle", "AUTOMOBILE").alias("need_type"), F.when(F.col("kind") == "home", 10000.0).alias("amount_min"), "amount_max", F.lit(None).cast("int").alias("term_min"), F.col("term_months").alias("term_max"))


def pairs(profile: DataFrame, o: DataFrame) -> DataFrame:
    """Profiles with every offer of their own nation's banks.

    There are few nations, so each nation's offers are dealt into parts and its profiles go to all of them.
    """
    part = F.pmod(F.xxhash64("offer_id"), F.lit(PARTS)).cast("int")
    return profile.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).join(o.withColumn("part", part), ["country", "part"]).drop("part")


LIKENESS = ["country", "need_type", "amount_min", "rate", "fee_lira", "term_max", "amount_max", "offer_id"]


def faced(profile: DataFrame, o: DataFrame, most: int) -> DataFrame:
    """The rows of `pairs` for at most so many offers, where all pairs are the result and not only the best of them.

    Only offers are shuffled and sorted, never pairs: by ranges of their conditions, in as many tasks as the pairs ask
    for.  A task's offers of like conditions stand together and meet the profiles in one order, so their pairs' outcomes
    repeat and take little room in files.
    """
    of = [r["count"] for r in profile.groupBy("country").count().collect()]
    if sum(of) > KNOWN:
        return pairs(profile, o)
    n = max(profile.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_OFFERS), -(-most * max(of, default=0) // TASK_PAIRS))
    # a join leaves out the sorts below it, though not those below a condition that is not deterministic
    in_order = F.monotonically_increasing_id() >= 0
    rows = o.select("term_min", *LIKENESS).repartitionByRange(n, *LIKENESS).sortWithinPartitions(*LIKENESS).where(in_order)
    known = profile.coalesce(1).sortWithinPartitions("country", "customer_type", "months", "amount").where(in_order)
    return rows.join(F.broadcast(known), "country")


PAIRS_SQL = OFFERS_SQL + f""",
    sold AS (SELECT *, CASE kind WHEN 'card' THEN 'HOUSEHOLD' WHEN 'vehicle' THEN 'AUTOMOBILE' END AS need_type, CASE WHEN kind = 'home' THEN 10000.0::DOUBLE END AS amount_min, CASE WHEN fee_unit = 'lira' THEN fee END AS fee_lira FROM offers),
    profile AS (SELECT c_custkey AS profile_id, n_name AS country, c_mktsegment AS customer_type, c_acctbal * 5 AS amount, CAST(c_custkey % 48 + 1 AS INTEGER) AS months FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 100 = 0),
    held AS (SELECT profile_id, offer_id, rate, fill, amount, months, fee_lira,
        list_filter([CASE WHEN need_type IS NOT NULL AND customer_type IS NOT NULL AND need_type <> customer_type THEN 'customer_type' END, CASE WHEN amount_min IS NOT NULL AND NOT coalesce(amount >= amount_min, false) THEN 'amount_min' END,
          CASE WHEN amount_max IS NOT NULL AND NOT coalesce(amount <= amount_max, false) THEN 'amount_max' END, CASE WHEN term_months IS NOT NULL AND NOT months BETWEEN 0 AND term_months THEN 'term' END], lambda x: x IS NOT NULL) AS failed
        FROM profile JOIN sold USING (country)),
    costed AS (SELECT *, len(failed) = 0 AS eligible, CASE WHEN len(failed) = 0 AND rate > 0 AND rate < 15 THEN {PAYMENT.format(a='amount', r='rate', n='months')} * months + coalesce(fee_lira, 0) END AS cost FROM held)
"""


@query(PAIRS_SQL + "SELECT profile_id, offer_id, array_to_string(failed, ',') AS failed, eligible, floor((cost) * 1e4 + 0.5) / 1e4 AS cost FROM costed")
def eligibility_reasons(spark, sf_dir):
    rows = faced(profiles(spark, sf_dir), conditioned(spark, sf_dir), table(spark, sf_dir, "lineitem").count())
    return eligibility.reasons(rows).select("profile_id", "offer_id", eligibility.failing("bits", ",").alias("failed"), "eligible", fixed("cost", 4).alias("cost"))


@query(PAIRS_SQL + ", tiered AS (SELECT *, CASE WHEN eligible AND cost IS NOT NULL THEN 0 WHEN eligible THEN 1 ELSE 2 END AS tier FROM costed) SELECT profile_id, offer_id, tier, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY tier, CASE tier WHEN 0 THEN round(cost, 4) WHEN 1 THEN -fill ELSE 0 END, offer_id) AS INTEGER) AS place FROM tiered QUALIFY place <= 5")
def eligibility_rank(spark, sf_dir):
    """The five best offers of each profile, as the answer shows them."""
    from pyspark.sql import Window as W

    within = F.when(F.col("tier") == 0, F.round("within", 4)).otherwise(F.col("within"))
    able = eligibility.contenders(conditioned(spark, sf_dir), 5)
    rows = eligibility.foremost(eligibility.tier(eligibility.reasons(pairs(profiles(spark, sf_dir), able))).withColumn("within", within), 5)
    w = W.partitionBy("profile_id").orderBy("tier", "within", "offer_id")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 5").select("profile_id", "offer_id", "tier", "place")


@query(OFFERS_SQL + "SELECT offer_id, bank, ends_on, CAST(date_diff('day', DATE '1998-06-01', ends_on) AS INTEGER) AS days_left FROM offers WHERE ends_on BETWEEN DATE '1998-06-01' AND DATE '1998-06-08'")
def ends_soon(spark, sf_dir):
    days = F.datediff("ends_on", F.to_date(F.lit("1998-06-01")))
    return offers(spark, sf_dir).select("offer_id", "bank", "ends_on", days.alias("days_left")).where(days.between(0, 7))


@query(OFFERS_SQL + "SELECT offer_id, ends_on FROM offers WHERE ends_on < DATE '1996-01-01' AND bank NOT IN (SELECT s_name FROM supplier WHERE s_acctbal < 0)")
def expired_purge(spark, sf_dir):
    """Offers that a purge would delete: expired and not of a protected bank; no end date is not expired."""
    held = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_name").alias("bank"))
    expired = F.coalesce(F.col("ends_on") < F.to_date(F.lit("1996-01-01")), F.lit(False))
    return offers(spark, sf_dir).where(expired).join(held, "bank", "left_anti").select("offer_id", "ends_on")


FIELDS = ["rate", "amount_max", "term_months", "fee", "reward"]


@query(OFFERS_SQL + "SELECT offer_id, field, value FROM offers, LATERAL (VALUES ('rate', rate), ('amount_max', amount_max), ('term_months', CAST(term_months AS DOUBLE)), ('fee', fee), ('reward', reward)) t(field, value) WHERE value IS NOT NULL")
def export_flat_tall(spark, sf_dir):
    pairs_ = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in FIELDS)
    return offers(spark, sf_dir).selectExpr("offer_id", f"stack({len(FIELDS)}, {pairs_}) AS (field, value)").where("value IS NOT NULL")


@query(OFFERS_SQL + "SELECT field, count(*) - count(value) AS nulls, floor((100.0 * (count(*) - count(value)) / count(*)) * 1e4 + 0.5) / 1e4 AS percent FROM offers, LATERAL (VALUES ('rate', rate), ('amount_max', amount_max), ('term_months', CAST(term_months AS DOUBLE)), ('fee', fee), ('reward', reward)) t(field, value) GROUP BY field")
def null_table(spark, sf_dir):
    got = offers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in FIELDS])
    tall = got.selectExpr("n", f"stack({len(FIELDS)}, {', '.join(f'{chr(39)}{f}{chr(39)}, {f}' for f in FIELDS)}) AS (field, nulls)")
    return tall.select("field", "nulls", fixed(F.lit(100.0) * F.col("nulls") / F.col("n"), 4).alias("percent"))


CHECKS = [("rate_over_9", "rate > 9"), ("rate_zero", "rate = 0"), ("amount_small", "amount_max < 5000"), ("amount_large", "amount_max > 90000"), ("term_long", "term_months > 48"), ("fee_large", "fee_unit = 'lira' AND fee > 700"), ("reward_large", "reward > amount_max * 0.07"), ("expired", "ends_on < DATE '1996-01-01'"), ("far_ahead", "ends_on > DATE '2001-01-01'")]


@query(OFFERS_SQL + "SELECT t.rule AS rule, t.n AS n, CASE WHEN t.n > 0 THEN 'warning' ELSE 'ok' END AS severity FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in CHECKS) + " FROM offers) s, LATERAL (VALUES " + ", ".join(f"('{k}', s.{k})" for k, _ in CHECKS) + ") t(rule, n)")
def outlier_checks(spark, sf_dir):
    got = offers(spark, sf_dir).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in CHECKS])
    pairs_ = ", ".join(f"'{k}', {k}" for k, _ in CHECKS)
    return got.selectExpr(f"stack({len(CHECKS)}, {pairs_}) AS (rule, n)").withColumn("severity", F.when(F.col("n") > 0, "warning").otherwise("ok"))


@query(OFFERS_SQL + "SELECT bank, count(rate) AS n, min(rate) AS low, max(rate) AS high FROM offers GROUP BY bank HAVING count(rate) > 1 AND max(rate) - min(rate) > 5")
def contradictions(spark, sf_dir):
    got = offers(spark, sf_dir).groupBy("bank").agg(F.count("rate").alias("n"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    return got.where("n > 1 AND high - low > 5")


@query(OFFERS_SQL + """SELECT bank, count(*) AS n, min(rate_base) AS rate_low, max(rate_base) AS rate_high, count(*) FILTER (WHERE rate_base = 0) AS zero_rates, max(term_months) AS longest, count(*) FILTER (WHERE fee_free) AS fee_free,
    CAST(date_diff('day', max(ends_on), DATE '2001-12-31') AS INTEGER) AS stale_days, floor((count(*) * 100.0 / (SELECT count(*) FROM based)) * 1e4 + 0.5) / 1e4 AS share FROM based GROUP BY bank""")
def bank_profile(spark, sf_dir):
    o = offers(spark, sf_dir).withColumn("base", ranking.reduced("rate"))
    got = o.groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.min("base").alias("rate_low"), F.max("base").alias("rate_high"), F.count_if(F.col("base") == 0).alias("zero_rates"), F.max("term_months").alias("longest"), F.count_if(F.coalesce("fee_free", F.lit(False))).alias("fee_free"), F.datediff(F.to_date(F.lit("2001-12-31")), F.max("ends_on")).alias("stale_days"))
    total = got.agg(F.sum("n").alias("total"))
    return got.crossJoin(F.broadcast(total)).withColumn("share", fixed(F.col("n") * F.lit(100.0) / F.col("total"), 4)).drop("total")


@query(OFFERS_SQL + ", candidates AS (SELECT split_part(offer_id, '-', 1) AS doc, CAST(split_part(offer_id, '-', 2) AS INTEGER) // 3 AS start, CAST(split_part(offer_id, '-', 2) AS INTEGER) // 3 + 4 AS \"end\", kind AS field, round(rate, 6) AS distance, offer_id AS rule FROM offers WHERE kind IS NOT NULL AND rate IS NOT NULL) SELECT doc, start, field, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc, start, \"end\" ORDER BY distance, rule) AS n FROM candidates) WHERE n = 1")
def span_ownership(spark, sf_dir):
    line = F.split_part("offer_id", F.lit("-"), F.lit(2)).cast("int")
    start = F.floor(line / 3).cast("int")
    c = offers(spark, sf_dir).where("kind IS NOT NULL AND rate IS NOT NULL").select(F.split_part("offer_id", F.lit("-"), F.lit(1)).alias("doc"), start.alias("start"), (start + 4).alias("end"), F.col("kind").alias("field"), F.round("rate", 6).alias("distance"), F.col("offer_id").alias("rule"))
    return records.owners(c).select("doc", "start", "field", "rule")


@query(OFFERS_SQL + """, c AS (SELECT bank AS doc, kind AS field, amount_max AS value, rate AS start, CASE kind WHEN 'home' THEN 'highest' WHEN 'need' THEN 'lowest' WHEN 'card' THEN 'nearest' ELSE 'first' END AS mode, fill AS confidence, offer_id FROM offers WHERE kind IS NOT NULL AND amount_max IS NOT NULL AND rate IS NOT NULL),
    banded AS (SELECT *, max(confidence) OVER (PARTITION BY doc, field) AS top FROM c)
    SELECT doc, field, mode, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY CASE mode WHEN 'highest' THEN -value WHEN 'lowest' THEN value WHEN 'nearest' THEN -confidence ELSE start END, confidence DESC, start) AS n
      FROM banded WHERE mode NOT IN ('highest', 'lowest') OR confidence >= top - 0.15) WHERE n = 1 AND mode IN ('highest', 'lowest')""")
def candidate_select(spark, sf_dir):
    mode = F.when(F.col("kind") == "home", "highest").when(F.col("kind") == "need", "lowest").when(F.col("kind") == "card", "nearest").otherwise("first")
    c = offers(spark, sf_dir).where("kind IS NOT NULL AND amount_max IS NOT NULL AND rate IS NOT NULL").select(F.col("bank").alias("doc"), F.col("kind").alias("field"), F.col("amount_max").alias("value"), F.col("rate").alias("start"), mode.alias("mode"), F.col("fill").alias("confidence"))
    return records.chosen(c).where(F.col("mode").isin("highest", "lowest")).select("doc", "field", "mode", "value", "confidence")


@query(OFFERS_SQL + """, r AS (SELECT offer_id AS doc, 'rate' AS field, rate AS v, 0.8::DOUBLE AS c FROM offers WHERE rate IS NOT NULL UNION ALL SELECT offer_id, 'amount', amount_max, 0.7::DOUBLE FROM offers WHERE amount_max IS NOT NULL),
    m AS (SELECT offer_id AS doc, 'rate' AS field, CASE WHEN fee_unit = 'lira' THEN rate + 1 ELSE rate * 1.001::DOUBLE END AS v, 0.6::DOUBLE AS c FROM offers WHERE rate IS NOT NULL AND kind <> 'card' UNION ALL SELECT offer_id, 'amount', CASE WHEN fee_unit = 'percent' THEN amount_max * 2 ELSE amount_max END, 0.75::DOUBLE FROM offers WHERE amount_max IS NOT NULL AND kind <> 'home'),
    j AS (SELECT coalesce(r.doc, m.doc) AS doc, coalesce(r.field, m.field) AS field, r.v AS rv, r.c AS rc, m.v AS mv, m.c AS mc, CASE WHEN greatest(abs(r.v), abs(m.v)) = 0 THEN true ELSE abs(r.v - m.v) / greatest(abs(r.v), abs(m.v)) <= 0.01 END AS same FROM r FULL JOIN m ON r.doc = m.doc AND r.field = m.field)
    SELECT doc, field, CASE WHEN rv IS NULL OR mv IS NULL THEN coalesce(rv, mv) WHEN same OR field = 'rate' THEN rv ELSE mv END AS value,
      floor((CASE WHEN rv IS NULL OR mv IS NULL THEN coalesce(rc, mc) WHEN same THEN least(1.0::DOUBLE, greatest(rc, mc) + 0.08::DOUBLE) WHEN field = 'rate' THEN rc - 0.25::DOUBLE ELSE mc - 0.25::DOUBLE END) * 1e4 + 0.5) / 1e4 AS confidence,
      CASE WHEN mv IS NULL THEN 'rule' WHEN rv IS NULL THEN 'model' WHEN same THEN 'hybrid' WHEN field = 'rate' THEN 'conflict_rule' ELSE 'conflict_model' END AS method FROM j""")
def reconcile_layers(spark, sf_dir):
    o = offers(spark, sf_dir)
    doc = F.col("offer_id").alias("doc")
    cells = lambda rows, field, value, c: rows.select(doc, F.lit(field).alias("field"), value.alias("value"), F.lit(c).alias("confidence"))
    r = cells(o.where("rate IS NOT NULL"), "rate", F.col("rate"), 0.8).unionByName(cells(o.where("amount_max IS NOT NULL"), "amount", F.col("amount_max"), 0.7))
    m = cells(o.where("rate IS NOT NULL AND kind <> 'card'"), "rate", F.when(F.col("fee_unit") == "lira", F.col("rate") + 1).otherwise(F.col("rate") * 1.001), 0.6).unionByName(cells(o.where("amount_max IS NOT NULL AND kind <> 'home'"), "amount", F.when(F.col("fee_unit") == "percent", F.col("amount_max") * 2).otherwise(F.col("amount_max")), 0.75))
    return records.reconciled(r, m, ["rate"]).withColumn("confidence", fixed("confidence", 4))
