"""Language identification by the nearest of several centroids per language (operator 2).

Texts become normalised TF-IDF vectors of hashed character n-grams.  Per language a few spherical k-means centroids
are fitted on a bounded sample of labelled rows; a text gets the language of the centroid of largest cosine, and is
rejected if even that is farther than nearly all labelled texts of that language were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Hashed n-gram dimensions; n-grams of 1 to 3 characters.
DIMS = 1 << 14
#: Labelled rows a language that the centroids are fitted on.  The driver holds a vector of DIMS floats for each.
FIT_ROWS = 250
CENTROIDS = 3
#: First bits of a text's hash by which texts are counted to find the least ones.
RANGE_BITS = 10
#: A text is rejected below this quantile of its language's labelled cosines, less a margin: texts unlike any language.
REJECT_QUANTILE, REJECT_MARGIN = 0.001, 0.8

NOT_LETTER = regex.compile(r"[^\p{L}]+")
LETTER = regex.compile(r"\p{L}").search


def counts(text: str) -> np.ndarray:
    """Hashed counts of 1- to 3-grams of the whole text: lower case, each run of non-letters one blank."""
    u = np.frombuffer((" " + NOT_LETTER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32)
    two = u[:-1] * np.uint32(0x9E3779B1) ^ u[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ u[2:]
    hashed = np.concatenate([u * np.uint32(0x27D4EB2F), two * np.uint32(0x2545F491), three * np.uint32(0x165667B1)])
    return np.bincount((hashed ^ hashed >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(18), minlength=DIMS)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


class Model:
    """idf, the centroids with their languages, and the least cosine of each language."""

    def __init__(self, texts: list[str], langs: list[str]):
        x, own = np.zeros((len(texts), DIMS), np.float32), np.array(langs, dtype=object)
        for row, t in zip(x, texts, strict=True):
            row[:] = np.log1p(counts(t))
        self.idf = (np.log((1 + len(texts)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        parts = [(lang, clustered(x[own == lang])) for lang in sorted(set(langs))]
        self.langs = [lang for lang, c in parts for _ in c]
        self.centroids = np.concatenate([c for _, c in parts]) if parts else np.zeros((0, DIMS), np.float32)
        self.least = {lang: REJECT_MARGIN * float(np.quantile((x[own == lang] @ c.T).max(1), REJECT_QUANTILE)) for lang, c in parts}

    def cosines(self, text: str) -> np.ndarray:
        v = np.log1p(counts(text)).astype(np.float32) * self.idf
        return self.centroids @ v / max(float(np.linalg.norm(v)), 1e-12)


def clustered(x: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-point start."""
    at = [0]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin((x @ x[at].T).max(1))))
    c = x[at]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = unit(np.array([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c.astype(np.float32)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most fit_rows distinct texts of each language, those of smallest hash; rows without label or letter are left out.

    Copies of a text count once, so a language whose rows repeat few texts is learned from all of those.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).withColumn("h", F.xxhash64("text"))
    # hashes are counted by their first bits; only those up to the range that holds the last one wanted are put in order
    hashes = rows.select("lang", "h").distinct().withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("range"))
    ranges = hashes.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", upto - F.col("n")).where(F.col("before") < fit_rows)
    last = ranges.groupBy("lang").agg(F.max("range").alias("last"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    least = hashes.join(F.broadcast(last), "lang").where(F.col("range") <= F.col("last")).withColumn("place", place).where(F.col("place") <= fit_rows).select("lang", "h")
    got = rows.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()
    return Model([r["text"] for r in got], [r["lang"] for r in got])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def judged(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score and whether the text is rejected."""
    if text is None or not model.langs or not LETTER(text):
        return "und", 0.0, True
    c = model.cosines(text)
    i = int(c.argmax())
    return model.langs[i], min(1.0, max(0.0, float(c[i]))), bool(c[i] < model.least[model.langs[i]])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected, and the columns to carry (not of those names).

    lang_pred is `und`, with score 0 and rejected true, for null texts and texts without a letter, or if the model
    learned nothing.  score is the cosine, 0 to 1.  Other texts always get the nearest language; rejected says that it
    is too far.  Repeated rows each get a row, an empty table none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = pd.DataFrame([judged(held.value, t) for t in frame["_text"]], columns=["lang_pred", "score", "rejected"], index=frame.index)
            yield pd.concat([frame.drop(columns="_text"), got], axis=1)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *(carry or []))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_text")
    return rows.mapInPandas(run, f"{kept}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([not judged(held.value, t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
