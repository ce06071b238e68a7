"""Freshness of watched pages: what each poll says against the state before, in batch and as a stream.

A poll has url, seq, ts and digest (null: unreachable).  The first sight of a page is not a change, an unreachable
poll leaves the state as it is, and the time of the last change is kept over unchanged polls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def transitions(polls: DataFrame) -> DataFrame:
    """url, seq, state in {first, unchanged, changed, unreachable} and changed_at, over a table of polls."""
    w = W.partitionBy("url").orderBy("seq")
    before = F.last("digest", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    state = F.when(F.col("digest").isNull(), "unreachable").when(F.col("before").isNull(), "first").when(F.col("before") == F.col("digest"), "unchanged").otherwise("changed")
    rows = polls.withColumn("before", before).withColumn("state", state)
    changed = F.last(F.when(F.col("state") == "changed", F.col("ts")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("url", "seq", "state", changed.alias("changed_at"))


def stream_transitions(polls: DataFrame) -> DataFrame:
    """The same over a streaming frame; the state of a url is its digest and the time of its last change."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, changed = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.digest is None:
                kind = "unreachable"
            elif digest is None:
                kind, digest = "first", r.digest
            elif digest == r.digest:
                kind = "unchanged"
            else:
                kind, digest, changed = "changed", r.digest, r.ts
            out.append((key[0], r.seq, kind, changed))
        state.update((digest, changed))
        yield pd.DataFrame(out, columns=["url", "seq", "state", "changed_at"])

    schema = "url string, seq long, state string, changed_at timestamp"
    return polls.groupBy("url").applyInPandasWithState(run, schema, "digest string, changed_at timestamp", "append", GroupStateTimeout.NoTimeout)


def triggers(rows: DataFrame, ts: str, hours: list[int]) -> DataFrame:
    """next_run (strictly after) and previous_run (at or before) of a daily calendar of full hours."""
    day = F.date_trunc("day", F.col(ts))
    shift = lambda d, h: day + F.make_dt_interval(F.lit(d), F.lit(h))
    slots = F.array(*[shift(d, h) for d in (-1, 0, 1) for h in sorted(hours)])
    return rows.withColumns({"next_run": F.array_min(F.filter(slots, lambda s: s > F.col(ts))), "previous_run": F.array_max(F.filter(slots, lambda s: s <= F.col(ts)))})
