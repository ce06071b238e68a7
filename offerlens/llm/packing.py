"""Packing into length buckets of least padding (operator 10).

Dynamic programming over the histogram of all lengths chooses the bucket boundaries that minimise padding; inside each
bucket documents form batches of a token budget.  The histogram has a bounded number of cells whatever the input, so
it alone goes to the driver.  Each length up to FINE, several times the usual budget, has a cell of its own; longer
documents, which are batches of their own, share cells.  A bucket is padded to its longest member, not to a cell's top.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lengths up to FINE have a cell each; beyond, each doubling is cut in STEPS cells.  2,000,000,000 words need < 74,000.
FINE, STEPS = 1 << 16, 512
#: Rows of a bucket that are numbered together.
SHARD_ROWS = 50_000


def length(text: Column) -> Column:
    """White-space separated words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cell(n: Column) -> Column:
    """The cell of a length: the least cell top that is not below it."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(FINE)).cast("double"))))
    step = power / STEPS
    return F.when(n <= FINE, n).otherwise(F.ceil(n / step) * step).cast("long")


def boundaries(tops: list[int], counts: list[int], k: int) -> list[int]:
    """At most k of the tops such that rounding each cell up to the next chosen one pads least.

    The best start of the last bucket moves up with its end, so for each number of buckets all ends are settled by
    halving: the middle end first, then those on either side between the starts found, a whole level at a time.
    """
    order = np.argsort(tops)
    v, c = np.array(tops, dtype=np.float64)[order], np.array(counts, dtype=np.float64)[order]
    n, k = len(v), min(k, len(v))
    if not n:
        return []
    below, weight = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * v)])
    best = v * below[1:] - weight[1:]  # one bucket for cells 0..j
    back = np.full((k, n), -1)
    for b in range(1, k):
        now = best.copy()
        low, high, first, last = (np.array([x]) for x in (1, n - 1, 0, n - 2))  # ends low..high, whose last bucket starts after a cell of first..last
        while len(low):
            j = (low + high) // 2
            sizes = np.minimum(last, j - 1) - first + 1
            edge = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(j)), sizes)
            i = np.arange(len(own)) - edge[own] + first[own]
            cost = best[i] + v[j[own]] * (below[j[own] + 1] - below[i + 1]) - (weight[j[own] + 1] - weight[i + 1])
            least = np.minimum.reduceat(cost, edge)
            hit = np.flatnonzero(cost == least[own])
            at = i[hit[np.unique(own[hit], return_index=True)[1]]]
            better = least < now[j]
            now[j[better]], back[b, j[better]] = least[better], at[better]
            low, high, first, last = (np.concatenate(x) for x in ((low, j + 1), (j - 1, high), (first, at), (at, last)))
            open_ = low <= high
            low, high, first, last = low[open_], high[open_], first[open_], last[open_]
        best = now
    chosen, j = [], n - 1
    for b in range(k - 1, -1, -1):
        if b and back[b, j] < 0:
            continue
        chosen.append(int(v[j]))
        if not b:
            break
        j = int(back[b, j])
    return sorted(chosen)


def pack(docs: DataFrame, budget: int = 16_384, buckets: int = 16, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (0 is the shortest), padded_to, batch_id, slot.

    n_tokens is the length_col, null as 0 (a tokenizer's counts, say), or else counts white-space separated words; the
    budget is in the same unit.  padded_to is the length of the bucket's longest document.  A batch of a bucket holds budget // padded_to documents; a document
    longer than the budget is a batch of its own.  Null and empty texts have 0 tokens.  Batch ids are
    bucket-shard-number strings; ties and repeated rows are numbered in an arbitrary but complete order.  An empty table
    gives an empty result.  Shards, of about SHARD_ROWS rows, keep the numbering of a huge bucket in many tasks; each
    leaves at most one batch that is not full.
    """
    n_tokens = F.coalesce(F.col(length_col).cast("long"), F.lit(0)) if length_col else length(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), n_tokens.alias("n_tokens")).withColumn("cell", cell(F.col("n_tokens")))
    histogram = [tuple(r) for r in rows.groupBy("cell").agg(F.count(F.lit(1)), F.max("n_tokens")).collect()]
    tops = boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets) or [0]
    inside = [[h for h in histogram if (i == 0 or h[0] > tops[i - 1]) and h[0] <= top] for i, top in enumerate(tops)]
    sizes, longest = [sum(h[1] for h in own) for own in inside], [max((h[2] for h in own), default=0) for own in inside]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), F.col("bucket") + 1)
    bucket = F.lit(len(tops) - 1)
    for i in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("cell") <= tops[i], F.lit(i)).otherwise(bucket)
    placed = (
        rows.withColumn("bucket", bucket.cast("int"))
        .withColumn("padded_to", pick(longest))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), pick([-(-n // SHARD_ROWS) or 1 for n in sizes])))
    )
    number = F.row_number().over(W.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id")) - 1
    holds = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("long")
    return placed.withColumn("at", number).select(
        "doc_id", "n_tokens", "bucket", "padded_to",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("at") / holds).cast("long")).alias("batch_id"), (F.col("at") % holds).cast("int").alias("slot"),
    )
