"""How filters interact: joint failures of every set of filters, inverted to what each order of them removes (operator 13).

A document's failures are five flags.  The products of the flags of a set of filters, summed, are the set's joint
failures; those of all 32 sets tell everything: by inclusion and exclusion how many documents survive any filters, by
Möbius inversion how many fail exactly one, and, as a set's joint failures with alternating sign are its Harsanyi
dividend in the game of removed documents, each filter's Shapley value.  Texts are read once; after that a row holds a
digest, flags and counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
#: Weights by which documents are counted: all, of good quality, toxic.
WEIGHTS = ("n", "good", "toxic")


def flags(text: Column) -> list[Column]:
    """Whether a text fails filters A to D: few words, words that repeat, capitals, odd signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = F.size(words) < 50
    repeated = F.size(F.array_distinct(words)) * 100 < F.size(words) * 65
    capitals = F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5
    return [few, repeated, capitals, text.rlike("[#$%&*|]")]


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, n, good, toxic): documents by source and by which filters they fail, bit 0 for A to bit 4 for E."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags(F.col("text")))), F.lit(0))
    own = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), fails.alias("fails"))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    # copies are counted before they meet: a text's rows by id, then by part, of which there are no more than sources
    by_id = own.groupBy("digest", "fails", "part", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(marks, "doc_id", "left")
    by_id = by_id.select("digest", "fails", "part", "doc_id", "n", *[(F.col("n") * F.coalesce(w, F.lit(0))).alias(w) for w in WEIGHTS[1:]])
    known = F.col("doc_id").isNotNull()
    first = F.min(F.when(known, F.struct("doc_id", *WEIGHTS)))
    by_part = by_id.groupBy("digest", "fails", "part", known.alias("known")).agg(*[F.sum(w).alias(w) for w in WEIGHTS], first.alias("first"))
    by_part = by_part.withColumn("least", F.min("first.doc_id").over(W.partitionBy("digest")))
    # the rows of a text's least id pass E, and so do those without an id, as theirs is not known to be larger
    passed = lambda w: F.when(~F.col("known"), F.col(w)).when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{w}")).otherwise(0)
    ways = [F.struct(F.col("fails").alias("pattern"), *[passed(w).alias(w) for w in WEIGHTS]), F.struct((F.col("fails") + 16).alias("pattern"), *[(F.col(w) - passed(w)).alias(w) for w in WEIGHTS])]
    told = by_part.select("part", F.explode(F.array(*ways)).alias("x")).select("part", "x.*")
    return told.groupBy("part", "pattern").agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def joint_failures(told: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each weight an array of 32 sums, at the place of each set of filters the documents that fail all of it."""

    product = lambda sets: " * ".join(["1", *[f"(shiftright(pattern, {i}) & 1)" for i in range(len(FILTERS)) if sets >> i & 1]])
    return told.groupBy("part").agg(*[F.expr(f"array({', '.join(f'sum({w} * {product(s)})' for s in SETS)})").alias(w) for w in WEIGHTS])


def survivors(joint: str) -> Column:
    """By inclusion and exclusion: for each set of filters the documents that fail none of it."""
    signed = f"IF(bit_count(s) % 2 = 0, {joint}[s], -{joint}[s])"
    return F.expr(f"transform(sequence(0, 31), sets -> aggregate(sequence(0, 31), 0L, (sum, s) -> sum + IF(s & ~sets = 0, {signed}, 0L)))")


def shapley(joint: str) -> Column:
    """For each filter the sum over its sets T of their dividends (-1)^(|T|+1) joint[T] / |T|, times 120 orders: whole, as 1 to 5 divide 120."""
    share = f"IF(bit_count(s) % 2 = 1, {joint}[s], -{joint}[s]) * (120 div bit_count(s))"
    return F.expr(f"transform(sequence(0, 4), i -> aggregate(sequence(1, 31), 0L, (sum, s) -> sum + IF(shiftright(s, i) & 1 = 1, {share}, 0L)))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see the columns below.

    part (a source; null: empty), filter_order (all 120), step (1 to 5), kept, removed, redundant (failing the step's
    filter, removed earlier), unique_fails (failing it only), good_lost, toxic_lost (removed at this step, by label),
    shapley (removed by this filter over all orders).  All but the ids are counts of rows.

    Texts count whole, a null text as empty: it has few words and passes the other filters, as a copy of an empty text
    it fails E if its id is not the least.  Rows that repeat an id and text stand or fall together; rows without an id
    pass E, and no label is theirs.  Repeated labels of an id count once, with the largest mark; null marks are none.
    An empty table of documents gives no rows, an empty one of labels zeros.  Other columns are not read.
    """
    joint = joint_failures(patterns(docs, labels))
    cells = joint.select("part", *[survivors(w).alias(w) for w in WEIGHTS], shapley("n").alias("shapley"), F.expr("transform(sequence(0, 4), i -> n[shiftleft(1, i)])").alias("fails"))
    each = range(len(FILTERS))
    # Möbius inversion at the sets of one: failing i and nothing else is surviving all others less surviving all
    unique = F.expr("transform(sequence(0, 4), i -> n[31 ^ shiftleft(1, i)] - n[31])")
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, k + 1, FILTERS.index(o[k]), sum(1 << FILTERS.index(c) for c in o[:k])) for o in orders for k in each]
    # the 600 steps as one literal that each part's row is exploded by
    literal = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","k":{k},"i":{i},"b":{b}}}' for o, k, i, b in steps) + "]"), "array<struct<o string, k int, i int, b int>>"))
    rows = cells.select("part", *WEIGHTS, unique.alias("unique"), "shapley", "fails", literal.alias("s"))
    i, before = F.col("s.i"), F.col("s.b")
    after = before.bitwiseOR(F.expr("shiftleft(1, s.i)"))
    lost = lambda w: F.get(F.col(w), before) - F.get(F.col(w), after)
    return rows.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"), F.get("n", after).alias("kept"), lost("n").alias("removed"), (F.get("fails", i) - lost("n")).alias("redundant"),
        F.get("unique", i).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", i).alias("shapley"),
    )
