"""Comparison of offers: common base, criterion ranking, advantage score, winners and warnings.

An offer has offer_id, bank, kind, rate (% a month), amount_max, term_months, fee with fee_unit (lira, percent or
null), reward, fee_free and fill.  Missing is null and never zero; ties fall to the smaller offer_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Kinds whose rates can be compared.
FINANCING = ["need", "home", "vehicle", "business"]
# Default weights of the advantage score.
WEIGHTS = {"rate": 0.40, "fee": 0.25, "reward": 0.20, "term": 0.15}
#: Criterion -> column and whether less is better.
CRITERIA = {"lowest_rate": ("rate", True), "lowest_fee": ("fee", True), "longest_term": ("term_months", False), "highest_reward": ("reward", False)}


@dataclass(frozen=True)
class Scenario:
    """The principal and term on which percentages are turned into money."""

    principal: float
    months: int


def in_scope(kind: Column, field: str) -> Column:
    """Whether a field of this kind can be compared; an unknown kind has no comparable rate."""
    return F.coalesce(kind.isin(FINANCING), F.lit(False)) if field == "rate" else F.lit(True)


def reduced(field: str, scenario: Scenario | None = None) -> Column:
    """A field on the common base: null if missing, out of scope, or of a unit that can't be turned into money."""
    value = F.col(field)
    if field == "fee":
        percent = value * scenario.principal / 100 if scenario else F.lit(None).cast("double")
        value = F.when(F.col("fee_unit") == "lira", value).when(F.col("fee_unit") == "percent", percent)
    return F.when(in_scope(F.col("kind"), field), value)


def ranked(offers: DataFrame, criterion: str, k: int, scenario: Scenario | None = None) -> DataFrame:
    """The k best by a criterion, missing values last, with their rank.  The cut is part of the report: every task keeps k rows."""
    field, less = CRITERIA[criterion]
    best = offers.withColumn("value", reduced(field, scenario).cast("double"))
    order = [F.col("value").asc_nulls_last() if less else F.col("value").desc_nulls_last(), F.col("offer_id")]
    return best.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))


def normalized_weights(weights: dict[str, float] | None) -> dict[str, float]:
    w = {k: max(0.0, v) for k, v in (weights or {}).items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else dict(WEIGHTS)


def advantage(offers: DataFrame, weights: dict[str, float] | None = None, scenario: Scenario | None = None) -> DataFrame:
    """score, comparability and missing for each offer of the candidate set.

    Each criterion is min-max scaled over the candidates, 1 if all are equal, turned so that more is better; a missing
    one counts one half.  comparability sums the weights of what is present.  An offer free of fees whose fee is missing
    gets half the fee's weight more, and its fee counts as present.  Criteria of weight 0 don't take part.
    """
    w = {k: v for k, v in normalized_weights(weights).items() if v > 0}
    columns = {"rate": reduced("rate"), "fee": reduced("fee", scenario), "reward": reduced("reward"), "term": F.col("term_months")}
    less = {"rate": True, "fee": True, "reward": False, "term": False}
    rows = offers.withColumns({f"_{k}": columns[k].cast("double") for k in w})
    ends = rows.agg(*[f(f"_{k}").alias(f"_{k}_{n}") for k in w for n, f in (("low", F.min), ("high", F.max))])
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    score, comparable, missing = F.lit(0.0), F.lit(0.0), []
    for k, weight in w.items():
        v, low, high = F.col(f"_{k}"), F.col(f"_{k}_low"), F.col(f"_{k}_high")
        scaled = F.when(high == low, F.lit(1.0)).otherwise((high - v) / (high - low) if less[k] else (v - low) / (high - low))
        bonus = F.coalesce(F.col("fee_free"), F.lit(False)) & v.isNull() if k == "fee" else F.lit(False)
        score = score + F.when(v.isNotNull(), F.lit(weight) * scaled).otherwise(F.lit(weight) * 0.5) + F.when(bonus, F.lit(weight) * 0.5).otherwise(0.0)
        comparable = comparable + F.when(v.isNotNull() | bonus, F.lit(weight)).otherwise(0.0)
        missing.append(F.when(v.isNull() & ~bonus, F.lit(k)))
    return rows.select(*offers.columns, score.alias("score"), comparable.alias("comparability"), F.array_compact(F.array(*missing)).alias("missing"))


def winners(offers: DataFrame, group: str = "kind", scenario: Scenario | None = None) -> DataFrame:
    """For each group and criterion the best offer, its value, and the best value of any other bank."""
    out = None
    for name, (field, less) in CRITERIA.items():
        signed = F.when(F.lit(less), -reduced(field, scenario).cast("double")).otherwise(reduced(field, scenario).cast("double"))
        rows = offers.withColumn("_v", signed).where("_v IS NOT NULL")
        # best of each bank first: a bank's rows combine before any shuffle
        banks = rows.groupBy(group, "bank").agg(F.max("_v").alias("_v"), F.min_by("offer_id", F.struct(-F.col("_v"), "offer_id")).alias("offer_id"))
        w = W.partitionBy(group).orderBy(F.col("_v").desc(), "offer_id")
        best = banks.withColumns({"_n": F.row_number().over(w), "rival": F.lead("_v").over(w)}).where("_n = 1")
        sign = -1.0 if less else 1.0
        own = best.select(group, F.lit(name).alias("criterion"), "offer_id", "bank", (F.col("_v") * sign).alias("value"), (F.col("rival") * sign).alias("rival_value"))
        out = own if out is None else out.unionByName(own)
    return out


def best_per_bank(offers: DataFrame) -> DataFrame:
    """The fullest offer of each bank."""
    order = F.struct(-F.col("fill"), F.col("offer_id"))
    return offers.groupBy("bank").agg(F.min_by("offer_id", order).alias("offer_id"), F.max("fill").alias("fill"))


def warnings(offers: DataFrame, group: str) -> DataFrame:
    """Why the offers of a group can't be compared outright; only groups of two or more."""
    got = offers.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fee_unit").alias("units"), F.countDistinct("term_months").alias("terms"), F.countDistinct("kind").alias("kinds"),
        F.count_if(reduced("rate").isNull()).alias("no_rate"),
    )
    kinds = [(F.col("units") > 1, "unit_mix", True), (F.col("terms") > 1, "term_mix", False), (F.col("no_rate") > 0, "missing_rate", False), (F.col("kinds") > 1, "kind_mix", False)]
    listed = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("warning"), F.lit(b).alias("blocking"))) for cond, k, b in kinds]))
    return got.where("n > 1").select(group, "n", F.inline(listed))
