"""Blocks of documents that ask hash-partitioned tables and get their answers back.

Several operators need, for each symbol or passage of a document, something that depends on all documents.  One row
for each of those would move many times the text.  So documents travel in blocks of a few MB: a block sends each
distinct question once, to the partition of the question's hash, and that partition answers per block.  A question
that a third of all documents asks thus arrives once per block, not once per document, and no partition holds more
than its hash share.  Spark does the partitioning, shuffling and recovery; numpy works inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20


#: Compression of texts, which travel once and are read several times; other values are mostly digests, where 1 does.
TEXT_LEVEL = 5


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(a.tobytes()) for a in arrays], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(a.tobytes() for a in arrays))


def spread(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays that squeeze() took."""
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    head, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(head, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


#: Stands for a null id inside blocks.
NO_ID = -(2**63)


class Block:
    """Some documents in ascending order of id: ids, row keys, where each starts and ends in the bytes, and the bytes (UTF-8)."""

    def __init__(self, payload: bytes):
        self.ids, self.keys, sizes, self.bytes = spread(payload, np.int64, np.int64, np.int64, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def doc_ids(self) -> list[int | None]:
        return [None if i == NO_ID else i for i in self.ids.tolist()]

    def texts(self) -> Iterator[str]:
        raw = self.bytes.tobytes()
        for a, b in zip(self.starts, self.ends, strict=True):
            yield raw[a:b].decode()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text for each part of a table of words or n-grams.
PART_BYTES = 2 << 20


def parts_of(docs: DataFrame, text_col: str = "text") -> int:
    """Into how many parts by hash to deal the words or n-grams of all texts, so that no part's share grows with the input.

    Where texts are few, a block has many values of a part, which travel as one compressed row; where they are very
    many it has one or none.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(1, -(-int(size) // PART_BYTES))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK_BYTES, key_col: str | None = None) -> DataFrame:
    """(block, payload): documents in blocks, dealt out by block.  A null text counts as empty.

    key_col: a long that tells rows apart where ids repeat or are null; it travels beside the id.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, ids, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i] if keys else 0))
            own = [texts[i] for i in order]
            long = lambda values: np.array(values, np.int64)
            payload = squeeze(long([ids[i] for i in order]), long([keys[i] for i in order] if keys else []), long([len(t) for t in own]), np.frombuffer(b"".join(own), np.uint8), level=TEXT_LEVEL)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + seq], pa.int64()), pa.array([payload], pa.binary())], ["block", "payload"])

        for batch in batches:
            ks = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for i, t, k in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), ks, strict=True):
                t = t or b""
                if ids and size + len(t) > limit:
                    yield block()
                    seq, ids, keys, texts, size = seq + 1, [], [], [], 0
                ids.append(NO_ID if i is None else i)
                if k is not None:
                    keys.append(k)
                texts.append(t)
                size += len(t)
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(key_col).cast("long").alias("key")] if key_col else []))
    return rows.mapInArrow(pack, "block long, payload binary").repartition(partitions(docs.sparkSession), "block")


def each(blocks: DataFrame, f, schema: str) -> DataFrame:
    """f(block id, Block) -> DataFrames, for each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, payload in zip(frame["block"], frame["payload"], strict=True):
                yield from f(int(b), Block(payload))

    return blocks.mapInPandas(run, schema)


def answered(blocks: DataFrame, answers: DataFrame, f, schema: str, all_blocks: bool = True) -> DataFrame:
    """f(block id, Block, its answers) -> DataFrame, for each block, or for each that has answers."""

    def run(key, left, right):
        if not len(left) or not (all_blocks or len(right)):
            return pd.DataFrame(columns=names)
        return f(int(key[0]), Block(left["payload"].iloc[0]), right)

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)
