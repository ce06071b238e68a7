"""Gates after reconciliation, in passes: a refused cell is read again from its own phrase and gated again, until nothing changes.

A cell has doc, field, value, unit and raw, the phrase that it was read from; it comes to carry where its value is from
(`given`, `tier`, `rederived`) and which gate refused it.  A cell is a function of itself and its text, so a pass is a
few columns and the passes are bounded: a phrase that was read again gives the same when it is read once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.functions import text
from offerlens.operators import conditions

#: Passes at most: as given, and as read again.
PASSES = 2
#: How a field's phrase is read, and the unit that it then has; a fee's unit is that of its phrase.
KINDS = {"rate": "rate", "discount": "rate", "amount_max": "money", "reward": "money", "points": "money", "fee": "fee", "term_months": "term", "instalments": "term", "ends_on": "date"}
UNITS = {"rate": "percent", "money": "lira", "term": "month", "date": "day"}


def of_kind(kind: str) -> Column:
    return F.col("field").isin([f for f, k in KINDS.items() if k == kind])


def read_again(raw: Column) -> Column:
    """Struct of value and unit of a phrase, by its cell's field; null value if the phrase has none."""
    value = F.when(of_kind("rate"), text.rate(raw)).when(of_kind("money"), text.money(raw)).when(of_kind("term"), text.term_months(raw).cast("double")).when(of_kind("fee"), F.coalesce(text.money(raw), text.rate(raw))).when(of_kind("date"), F.unix_date(text.date(raw)).cast("double"))
    unit = F.when(of_kind("fee"), text.unit_of(raw))
    for kind, name in UNITS.items():
        unit = F.when(of_kind(kind), name).otherwise(unit)
    return F.struct(value.alias("value"), unit.alias("unit"))


def from_tiers(value: Column, tiers: Column) -> Column:
    """Whether a largest amount is that of the text's tier table, which no phrase of it names."""
    return F.coalesce((F.col("field") == "amount_max") & text.near(value, tiers), F.lit(False))


def refusal(limits: dict[str, tuple[float, float]], zero_ok: set[str], units: dict[str, str]) -> Column:
    """The first gate that refuses a cell: unit, range (exclusive bounds), phrase (not in its text, white space aside); null if it passes."""
    value, bad_unit, bad_range = F.col("value"), F.lit(False), F.lit(False)
    for field, unit in units.items():
        bad_unit = F.when(F.col("field") == field, ~F.col("unit").eqNullSafe(F.lit(unit))).otherwise(bad_unit)
    for field, (low, high) in limits.items():
        ok = (value > low) & (value < high)
        bad_range = F.when(F.col("field") == field, ~F.coalesce(ok | (value == 0) if field in zero_ok else ok, F.lit(False))).otherwise(bad_range)
    return F.when(bad_unit, "unit").when(bad_range | value.isNull(), "range").when(~F.col("_stands"), "phrase")


def settled(cells: DataFrame, docs: DataFrame, limits: dict[str, tuple[float, float]], units: dict[str, str], zero_ok: set[str] = frozenset({"rate"}), passes: int = PASSES) -> DataFrame:
    """The cells with value and unit as settled, origin, refused and passes (how many each took).

    A value of the text's tier table is exempt from the gates.  A cell refused for its unit or range is read again from
    its phrase, if that stands in the text and says something else; one whose phrase does not stand there is not.  Then
    an instalment count above the document's largest passed term is refused as `term`.  docs has doc and text, one row
    each; cells of unknown documents are refused for their phrase.  Null phrases do not stand anywhere.
    """
    spaceless = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    held = docs.select("doc", F.col("text").alias("_text"), conditions.tier_max(F.col("text")).alias("_tiers"))
    rows = cells.join(held, "doc", "left").withColumn("_stands", F.coalesce(F.contains(spaceless(F.col("_text")), spaceless(F.col("raw"))), F.lit(False)))
    tier = from_tiers(F.col("value"), F.col("_tiers"))
    rows = rows.withColumns({"origin": F.when(tier, "tier").otherwise("given"), "refused": F.when(~tier, refusal(limits, zero_ok, units)), "passes": F.lit(1)}).drop("_text", "_tiers")
    # a phrase is read again only where that can count: a cell that passes is never retried, nor one that comes to pass
    rows = rows.withColumn("_again", F.when(F.col("refused").isin("unit", "range") & F.col("_stands"), read_again(F.col("raw"))))
    for _ in range(passes - 1):
        other = F.col("_again.value").isNotNull() & ~(F.col("_again.value").eqNullSafe(F.col("value")) & F.col("_again.unit").eqNullSafe(F.col("unit")))
        rows = rows.withColumn("_retry", F.coalesce(F.col("refused").isin("unit", "range") & F.col("_stands") & other, F.lit(False)))
        rows = rows.withColumns({"value": F.when(F.col("_retry"), F.col("_again.value")).otherwise(F.col("value")), "unit": F.when(F.col("_retry"), F.col("_again.unit")).otherwise(F.col("unit")), "origin": F.when(F.col("_retry"), "rederived").otherwise(F.col("origin")), "passes": F.col("passes") + F.col("_retry").cast("int")})
        rows = rows.withColumn("refused", F.when(F.col("_retry"), refusal(limits, zero_ok, units)).otherwise(F.col("refused"))).drop("_retry")
    # over the cells as the join has dealt them; a null doc names no document
    term = F.when((F.col("field") == "term_months") & F.col("refused").isNull() & F.col("doc").isNotNull(), F.col("value"))
    rows = rows.withColumn("_longest", F.max(term).over(W.partitionBy("doc")))
    over = (F.col("field") == "instalments") & F.col("refused").isNull() & (F.col("value") > F.col("_longest"))
    return rows.withColumn("refused", F.when(F.coalesce(over, F.lit(False)), "term").otherwise(F.col("refused"))).drop("_stands", "_again", "_longest")
