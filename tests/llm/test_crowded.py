"""Windows of crowded grams: what a block sends of a line that very many of its texts share."""

from __future__ import annotations

import dataclasses
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlens.llm import blocks, repeats


def test_known_windows_travel_as_runs(spark):
    rng = random.Random(3)
    words = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, n = words(160), 40
    docs = spark.createDataFrame([(i, words(90) + line + words(90)) for i in range(n)], "doc_id long, text string").coalesce(1)
    kind = dataclasses.replace(repeats.BYTES, group_limit=3)
    held = blocks.packed(docs, "doc_id", "text", kind.block_bytes, None)
    live = blocks.each(held, lambda block, b: repeats.ask(block, repeats.Layout(b, kind)), "h long, block long, n int, c int").where("n > 1").select("block", "h", F.lit(True).alias("crowded"))
    sent = blocks.answered(held, live, lambda block, b, own: repeats.windows(block, repeats.Layout(b, kind), own), repeats.WINDOWS, all_blocks=False)
    blocks_ = live.select("block").distinct().count()
    assert 0 < sent.where("snippet IS NULL").count() <= n  # one run a document at most, not one row for each of 61 windows
    whole = lambda k: sorted(map(tuple, repeats.without_repeated_bytes(docs, kind=k).collect()))
    assert blocks_ and whole(kind) == whole(repeats.BYTES)
    assert sum(r[2] for r in whole(kind)) == pytest.approx(160 * (n - 1), abs=8 * n)


def test_groups_of_snippets_are_read_without_a_frame_each(monkeypatch):
    word = [f"w{i}" for i in range(80)]
    text = lambda a, b: " ".join(word[a:b]).encode()
    rows = [(1, 0, 30, 1, 18, text(12, 60)), (1, 1, 30, 1, 13, text(17, 62)), (2, 0, 50, 2, 10, text(0, 40)), (3, 0, 70, 1, 10, text(20, 60)), (4, 1, 90, 2, 10, text(0, 34))]
    frame = pd.DataFrame([(h, b, at, b, at, n, before, t) for h, b, at, n, before, t in rows], columns=["h", "block", "at", "doc", "pos", "n", "before", "snippet"])
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    found = pd.concat(list(repeats.search(iter([frame]), repeats.WORDS)))
    # 43 words that two snippets share, all of one that stands twice, nothing of one that stands once or is too short
    assert sorted(map(tuple, found.to_numpy().tolist())) == [(0, 30, 13, 30), (0, 50, 10, 30), (1, 30, 13, 30)]
