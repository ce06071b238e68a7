"""Many queries against all paragraphs at once: blocked products of matrices, with the best of each block merged.

Vectors are dealt into parts and queries into groups; a tile is one part against one group, a product of two matrices
of bounded size.  A tile keeps, of each query, the best paragraph of each record and of those the first k; the tiles'
answers are merged by query.  No query, and no list of answers, is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Vectors and queries of a tile at most, on average; queries whose products are held at a time.
TILE_VECTORS, TILE_QUERIES, HELD = 1 << 16, 1 << 16, 64
#: Digits to which a cosine is rounded before it is ranked, so that equal vectors are equal whatever block they are in.
DIGITS = 9


def unit(column: pd.Series) -> np.ndarray:
    """Rows of a matrix, each of length one; a zero vector stays zero."""
    rows = np.stack([np.asarray(v, np.float64) for v in column])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def best_of(scores: np.ndarray, record: np.ndarray, starts: np.ndarray, own: int | None, k: int) -> list[tuple[int, float]]:
    """(place, score) of the first k records' best paragraphs; scores stand in order of record and paragraph, starts where a record's begin."""
    most = np.maximum.reduceat(scores, starts)
    if own is not None:
        most = np.where(record[starts] == own, -np.inf, most)
    least = np.partition(most, len(most) - k)[len(most) - k] if len(most) > k else -np.inf
    out = []
    for r in np.flatnonzero((most >= least) & (most > -np.inf)):
        end = starts[r + 1] if r + 1 < len(starts) else len(scores)
        out.append((int(starts[r] + scores[starts[r] : end].argmax()), float(most[r])))
    return out


def nearest_records(vectors: DataFrame, queries: DataFrame, k: int = 5, tile_vectors: int = TILE_VECTORS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, record_id, score): the k nearest records of each query, each by its nearest paragraph.

    vectors has vec_id, record_id and embedding, queries query_id, record_id and embedding; a query's own record is not
    an answer (null: all are).  score is the cosine, rounded; of equal ones the smaller vec_id counts.  Null embeddings
    are left out, a zero vector has cosine 0 with all, ids must not repeat.  Embeddings have one length, else numpy
    raises.  Empty tables give no rows; other columns are not read.
    """
    held = vectors.where("embedding IS NOT NULL AND record_id IS NOT NULL").select("vec_id", F.col("record_id").cast("long").alias("record_id"), "embedding")
    asked = queries.where("embedding IS NOT NULL").select("query_id", F.col("record_id").cast("long").alias("own"), "embedding")
    parts, groups = (max(1, -(-df.count() // n)) for df, n in ((held, tile_vectors), (asked, tile_queries)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("part", dealt("vec_id", parts)).withColumn("tile", every(groups))
    right = asked.withColumn("tile", dealt("query_id", groups)).withColumn("part", every(parts))

    def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(asking):
            own = own.sort_values(["record_id", "vec_id"])
            ids, record, matrix = own["vec_id"].to_numpy(), own["record_id"].to_numpy(), unit(own["embedding"])
            starts = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]]))
            for at in range(0, len(asking), HELD):
                some = asking.iloc[at : at + HELD]
                scores = np.round(unit(some["embedding"]) @ matrix.T, DIGITS)
                for query, mine, line in zip(some["query_id"], some["own"], scores, strict=True):
                    best = best_of(line, record, starts, None if pd.isna(mine) else int(mine), k)
                    best = sorted(((-s, int(ids[i]), int(record[i])) for i, s in best))[:k]
                    rows += [(int(query), v, r, -s) for s, v, r in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "record_id", "score"])

    found = left.groupBy("part", "tile").cogroup(right.groupBy("part", "tile")).applyInPandas(run, "query_id long, vec_id long, record_id long, score double")
    order = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    by_record = found.groupBy("query_id", "record_id").agg(F.min_by(F.struct("vec_id", "score"), order).alias("b")).select("query_id", "record_id", "b.*")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return by_record.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "record_id", "score")
