"""Dialogue state: which slots a turn fills itself, which it inherits from the turns before, and what is declared as inherited.

A turn has conv_id, turn, kind and a column for each of SLOTS (null: not stated).  A stated slot overrides.  An
unstated one is inherited for `expiry` turns after it was stated, with these bounds: a topic ends when a product is
named, a direction is a quality of its criterion and is inherited only with it, and an amount and a term are inherited
only out of a turn that had both (the profile).  A question put to the whole corpus inherits nothing and begins anew;
definitions and questions out of scope neither use nor change the state, and do not count as turns.

`resolved` is the batch form by windows over the last statements; `step` is one turn of the same fold, which the stream
keeps a state for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.functions import text
from offerlens.operators import questions

SLOTS = ["bank", "product", "topic", "criterion", "direction", "amount", "months"]
# Cues of questions to the whole corpus, of definitions, and of product classes, as search keys.
CORPUS_CUES = ["hangi banka", "tum banka", "butun banka", "her banka", "bankalarin"]
DEFINITION_CUES = ["nedir", "ne demek", "ne anlama gel", "aciklar misin", "aciklayabilir misin", "farki ne", "arasindaki fark"]
PRODUCT_CUES = {"konut": "home", "tasit": "car", "arac": "car", "ihtiyac": "personal", "katilma hesabi": "deposit", "kredi kart": "card"}


def kind(question: Column) -> Column:
    """neutral for definitions, corpus for questions to all banks, else plain."""
    key = text.search_key(question)
    return F.when(text.any_of(key, DEFINITION_CUES), "neutral").when(text.any_of(key, CORPUS_CUES), "corpus").otherwise("plain")


def stated(turns: DataFrame, banks: DataFrame) -> DataFrame:
    """conv_id, turn, kind and what each question (column question) states of SLOTS itself; of several banks the first by name."""
    q, key = F.col("question"), text.search_key(F.col("question"))
    asked = turns.select(F.struct("conv_id", "turn").alias("question_id"), "question")
    named = questions.recognised(asked, banks).groupBy("question_id").agg(F.min("bank").alias("bank")).select("question_id.*", "bank")
    product = F.coalesce(*[F.when(text.mentions(key, cue), F.lit(name)) for cue, name in PRODUCT_CUES.items()])
    topic = F.nullif(F.regexp_extract(key, r"\b([a-z]{4,}) kampanyasi", 1), F.lit(""))
    return turns.join(named, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", kind(q).alias("kind"), "bank", product.alias("product"), topic.alias("topic"), questions.criterion(q).alias("criterion"), questions.direction(q).alias("direction"), text.money(q).alias("amount"), text.term_months(q).alias("months"),
    )


def declared(carried: Column) -> Column:
    """What is inherited, slot by slot: the text that stands under an answer; empty if nothing is."""
    return F.array_join(F.transform(carried, lambda c: F.concat(c["slot"], F.lit(": "), c["value"])), " · ")


def resolved(turns: DataFrame, expiry: int = 3) -> DataFrame:
    """conv_id, turn, kind, SLOTS as resolved, and declared.  Turns of neutral kind have no slots.

    (conv_id, turn) must not repeat; null kinds are plain.  A conversation is put in order in one task, without being
    held there.  An empty table gives no rows; other columns are dropped.
    """
    turns = turns.withColumn("kind", F.coalesce("kind", F.lit("plain")))
    order = W.partitionBy("conv_id").orderBy("turn")
    live = turns.where("kind <> 'neutral'").withColumns({"_n": F.row_number().over(order), "_epoch": F.sum((F.col("kind") == "corpus").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))})
    own = W.partitionBy("conv_id", "_epoch").orderBy("turn")
    before, upto = own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(W.unboundedPreceding, 0)
    n, has = F.col("_n"), lambda s: F.col(s).isNotNull()
    at = lambda c, window: F.last(F.when(c, n), ignorenulls=True).over(window)
    live = live.withColumns({f"_{s}": F.last(F.when(has(s), F.struct(F.col(s).alias("v"), n.alias("n"))), ignorenulls=True).over(before) for s in SLOTS})
    both = has("amount") & has("months")
    lasts = F.coalesce((n - at(has("amount"), upto) <= expiry) & (n - at(has("months"), upto) <= expiry), F.lit(False))
    live = live.withColumn("_lasts", lasts).withColumns({"_both": at(both, before), "_broken": at(~F.col("_lasts"), before)})
    profile = F.col("_both").isNotNull() & (F.col("_broken").isNull() | (F.col("_broken") < F.col("_both")))
    later = lambda s, than: F.col(f"_{than}").isNull() | (F.col(f"_{s}.n") >= F.col(f"_{than}.n"))
    old = {s: ~has(s) & has(f"_{s}") & (n - F.col(f"_{s}.n") <= expiry) for s in SLOTS}
    old["topic"] &= ~has("product") & later("topic", "product")
    old["direction"] &= old["criterion"] & later("direction", "criterion")
    old |= {s: old[s] & profile for s in ("amount", "months")}
    old = {s: F.coalesce(c, F.lit(False)) for s, c in old.items()}
    shown = lambda s: F.col(f"_{s}.v").cast("long" if s == "amount" else "string").cast("string")
    carried = F.array_compact(F.array(*[F.when(old[s], F.struct(F.lit(s).alias("slot"), shown(s).alias("value"))) for s in SLOTS]))
    out = live.select("conv_id", "turn", "kind", *[F.when(old[s], F.col(f"_{s}.v")).otherwise(F.col(s)).alias(s) for s in SLOTS], declared(carried).alias("declared"))
    none = turns.where("kind = 'neutral'").select("conv_id", "turn", "kind", *[F.lit(None).cast(turns.schema[s].dataType).alias(s) for s in SLOTS], F.lit("").alias("declared"))
    return out.unionByName(none)


def step(state: dict, kind: str, said: dict, expiry: int) -> tuple[dict, dict, list[str]]:
    """(state, resolved slots, inherited ones) of one turn.  state has n, profile and slots: by name their value and the turn that stated it."""
    if kind == "neutral":
        return state, {}, []
    n, held = state.get("n", 0) + 1, state.get("slots", {}) if kind != "corpus" else {}
    alive = {s for s, (_, at) in held.items() if said.get(s) is None and n - at <= expiry}
    if said.get("product") is not None:
        alive.discard("topic")
    if "criterion" not in alive:
        alive.discard("direction")
    if not state.get("profile") or kind == "corpus":
        alive -= {"amount", "months"}
    slots = {s: [said[s], n] for s in SLOTS if said.get(s) is not None} | {s: held[s] for s in alive}
    return {"n": n, "profile": "amount" in slots and "months" in slots, "slots": slots}, {s: v for s, (v, _) in slots.items()}, [s for s in SLOTS if s in alive]
