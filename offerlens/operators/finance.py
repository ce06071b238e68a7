"""Instalment costs and term grids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instalment(amount: Column, percent_a_month: Column, months: Column) -> Column:
    """The monthly payment of an annuity; an equal share at rate 0; null for input that makes no sense."""
    i = percent_a_month / 100
    ok = (amount > 0) & (months > 0) & (percent_a_month >= 0)
    return F.when(ok, F.when(i == 0, amount / months).otherwise(amount * i / (1 - F.pow(1 + i, -months.cast("double")))))


def cost(amount: Column, percent_a_month: Column, months: Column, fee: Column | None = None) -> Column:
    """All payments, and the fee if there is one."""
    total = instalment(amount, percent_a_month, months) * months
    return total + F.coalesce(fee, F.lit(0.0)) if fee is not None else total


def sensitivity(offers: DataFrame, amount: float, grid: list[int]) -> DataFrame:
    """For each offer with a rate and a term: cost at each term of the grid and its own, and the difference to its own."""
    own = offers.where(F.col("rate").isNotNull() & (F.col("term_months") > 0))
    months = F.array_distinct(F.concat(F.array(*[F.lit(g) for g in grid]), F.array(F.col("term_months"))))
    rows = own.withColumn("months", F.explode(months)).where(F.col("months") <= F.col("term_months"))
    a = F.lit(float(amount))
    return rows.select(
        "offer_id", "months", instalment(a, F.col("rate"), F.col("months")).alias("payment"), cost(a, F.col("rate"), F.col("months")).alias("total"),
        (cost(a, F.col("rate"), F.col("months")) - cost(a, F.col("rate"), F.col("term_months"))).alias("total_delta"),
    )


def advice(grid: DataFrame, ceiling: float) -> DataFrame:
    """For each offer: the next shorter term than the longest, and the shortest whose payment is under the ceiling."""
    longest = F.max("months")
    got = grid.groupBy("offer_id").agg(longest.alias("longest"), F.array_sort(F.collect_list("months")).alias("terms"), F.min(F.when(F.col("payment") <= ceiling, F.col("months"))).alias("shortest_affordable"))
    return got.select("offer_id", "longest", F.array_max(F.filter("terms", lambda t: t < F.col("longest"))).alias("next_shorter"), "shortest_affordable")
