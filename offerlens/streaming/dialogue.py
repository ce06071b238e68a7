"""Dialogue state as a stream: each conversation's slots are kept as state and carried from turn to turn."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from offerlens.operators.dialogue import SLOTS, step

#: The state store that the processor's state variables need; the session's setting spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """Resolves the turns of a conversation in their order; one at or before the last seen is a repeat and passed over."""

    def __init__(self, expiry: int):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("dialogue", "last long, folded string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        last, state = (held[0], json.loads(held[1])) if held else (None, {})
        out = []
        for r in pd.concat(list(rows)).sort_values("turn").to_dict("records"):
            if last is not None and r["turn"] <= last:
                continue
            last = int(r["turn"])
            state, slots, carried = step(state, r["kind"], {s: r[s] for s in SLOTS if isinstance(r[s], str)}, self.expiry)
            out.append((int(key[0]), last, r["kind"], *[slots.get(s) for s in SLOTS], " · ".join(f"{s}: {slots[s]}" for s in carried)))
        if last is not None:
            self.state.update((last, json.dumps(state)))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "kind", *SLOTS, "declared"])

    def close(self) -> None:
        pass


def stream_resolved(turns: DataFrame, expiry: int = 3) -> DataFrame:
    """operators.dialogue.resolved over a streaming frame, in append mode; a conversation's turns must arrive in order, in one or more batches."""
    plain = F.coalesce("kind", F.lit("plain")).alias("kind")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain, *[F.col(s).cast("long" if s == "amount" else "string").cast("string").alias(s) for s in SLOTS])
    schema = f"conv_id long, turn long, kind string, {', '.join(f'{s} string' for s in SLOTS)}, declared string"
    out = rows.groupBy("conv_id").transformWithStateInPandas(Turns(expiry), schema, "append", "none")
    return out.withColumns({"amount": F.col("amount").cast("double"), "months": F.col("months").cast("int")})
