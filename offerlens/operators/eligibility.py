"""Whether customers meet offers' conditions, and why not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.operators.finance import cost


CHECKS = ["customer_type", "amount_min", "amount_max", "term"]


def failing(bits: str, separator: str | None = None) -> Column:
    """The names of the checks whose bits are set, as an array or as one text: looked up, not put together for each pair."""
    sets = [[c for i, c in enumerate(CHECKS) if n >> i & 1] for n in range(1 << len(CHECKS))]
    known = [F.array(*map(F.lit, x)).cast("array<string>") if separator is None else F.lit(separator.join(x)) for x in sets]
    return F.get(F.array(*known), F.col(bits))


def reasons(pairs: DataFrame) -> DataFrame:
    """For each (profile, offer): the checks that failed, eligibility, missing data, and the cost if eligible.

    pairs has profile_id, offer_id, customer_type, amount, months, need_type, amount_min, amount_max, term_min,
    term_max, rate and fee_lira.  A condition that an offer does not state, or a type the profile does not, is skipped.
    An offer without any condition fits, with no_data set.  bits has one for each failed check.  A cost needs a rate strictly between 0 and 15.
    """
    checks = [  # stated, met; in the order of CHECKS
        (F.col("need_type").isNotNull() & F.col("customer_type").isNotNull(), F.col("need_type") == F.col("customer_type")),
        (F.col("amount_min").isNotNull(), F.col("amount") >= F.col("amount_min")),
        (F.col("amount_max").isNotNull(), F.col("amount") <= F.col("amount_max")),
        (F.col("term_min").isNotNull() | F.col("term_max").isNotNull(), F.col("months").between(F.coalesce("term_min", F.lit(0)), F.coalesce("term_max", F.lit(10**6)))),
    ]
    stated = [s for s, _ in checks]
    some = stated[0] | stated[1] | stated[2] | stated[3]
    bits = [F.when(s & ~F.coalesce(met, F.lit(False)), 1 << i).otherwise(0) for i, (s, met) in enumerate(checks)]
    out = pairs.withColumns({"bits": bits[0] + bits[1] + bits[2] + bits[3], "no_data": ~some})
    out = out.withColumns({"failed": failing("bits"), "eligible": F.col("bits") == 0})
    total = cost(F.col("amount"), F.col("rate"), F.col("months"), F.col("fee_lira"))
    return out.withColumn("cost", F.when(F.col("eligible") & (F.col("rate") > 0) & (F.col("rate") < 15), total))


def tier(rows: DataFrame) -> DataFrame:
    """0: eligible with a cost, 1: eligible without one, 2: not eligible; and the key that orders within a tier."""
    t = F.when(F.col("eligible") & F.col("cost").isNotNull(), 0).when(F.col("eligible"), 1).otherwise(2)
    return rows.withColumns({"tier": t, "within": F.when(t == 0, F.col("cost")).when(t == 1, -F.col("fill")).otherwise(F.lit(0.0))})


def foremost(rows: DataFrame, most: int) -> DataFrame:
    """(profile_id, offer_id, tier, within): in each batch of rows, the first so many of each profile.

    The best of all are among them, so a later ranking sorts and shuffles few rows, not all pairs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.sort_values(["profile_id", "tier", "within", "offer_id"]).groupby("profile_id", sort=False).head(most)

    own = rows.select("profile_id", "offer_id", "tier", "within")
    return own.mapInPandas(run, own.schema)


#: Terms at most that are told apart when offers are thinned out; more are taken in as many steps.
LEVELS = 64


def outdone(kind: np.ndarray, roof: np.ndarray, reach: np.ndarray, most: int) -> np.ndarray:
    """Which rows have so many earlier rows of their kind with no lower roof and no shorter reach; kinds stand together, in ascending numbers.

    The running `most` largest roofs of the rows of at least some reach are as many running maxima: each takes in what
    the one before has let go.
    """
    levels = np.unique(reach)
    if len(levels) > LEVELS:
        levels = levels[np.linspace(0, len(levels) - 1, LEVELS).astype(int)]
    step, height = np.searchsorted(levels, reach), np.unique(roof, return_inverse=True)[1] + 1
    base = kind.astype(np.int64) * (height.max(initial=0) + 1)
    out = np.zeros(len(kind), bool)
    for i, level in enumerate(levels):
        rows = np.flatnonzero((reach >= level) | (step == i))
        low, own = base[rows], (base + height)[rows]
        # a row that only asks, its reach between two levels, gives the others nothing
        given = np.where(reach[rows] >= level, own, low)
        for _ in range(most):
            before = np.maximum(np.concatenate([[-1], np.maximum.accumulate(given)[:-1]]), low)
            given = np.minimum(given, before)
        asks = step[rows] == i
        out[rows[asks]] = before[asks] >= own[asks]
    return out


KIND = ["way", "country", "need_type", "amount_min", "term_min", "fee_lira"]


def contenders(offers: DataFrame, most: int) -> DataFrame:
    """The offers that can be among the first `most` of any profile of their country, each once.

    offers has offer_id, country and the columns that `reasons` reads of an offer.  An offer is left out if so many
    others come before it wherever it is eligible: of the same conditions and fee, with no lower cap and no shorter term, at
    a lower rate, or an equal one and a smaller offer_id (way 0), and likewise by fill if it has no cost (way 1 and, for
    profiles that nothing can be costed for, 2).  Those not eligible are ordered by offer_id alone, so the country's
    first ones do.  Offers of different rates must differ in cost as it is rounded.
    """
    priced = F.coalesce((F.col("rate") > 0) & (F.col("rate") < 15), F.lit(False))
    unstated = F.col("term_min").isNull() & F.col("term_max").isNull()
    way = F.array_compact(F.array(F.when(priced, F.struct(F.lit(0).alias("way"), F.col("fee_lira").alias("fee_lira"), F.col("rate").alias("first"))), F.struct(F.when(priced, 2).otherwise(1).alias("way"), F.lit(None).cast("double").alias("fee_lira"), (-F.col("fill")).alias("first"))))
    rows = offers.select("country", "need_type", "amount_min", "term_min", F.coalesce("amount_max", F.lit(float("inf"))).alias("roof"), F.when(unstated, float("inf")).otherwise(F.coalesce("term_max", F.lit(10**6))).cast("double").alias("reach"), "offer_id", F.inline(way))
    dealt = rows.repartition(*KIND).sortWithinPartitions(*KIND, "first", "offer_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # what is left so far of the last kind: nothing else can outdo what comes
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            old, k = 0 if held is None else len(held), f[KIND]
            same = ((k == k.shift()) | (k.isna() & k.shift().isna())).all(axis=1).to_numpy()
            kind = np.cumsum(~same)
            left = f[~outdone(kind, f["roof"].to_numpy(np.float64), f["reach"].to_numpy(np.float64), most)]
            yield left.loc[left.index >= old, ["offer_id"]]
            held = left[kind[left.index] == kind[-1]] if len(f) else held

    able = dealt.mapInPandas(run, "offer_id string").distinct()
    w = W.partitionBy("country").orderBy("offer_id")
    first = offers.select("country", "offer_id", F.row_number().over(w).alias("_n")).where(F.col("_n") <= most).select("offer_id")
    return offers.join(able.unionByName(first).distinct(), "offer_id", "left_semi")
