"""Near-duplicate documents by ProbMinHash over word shingles, banding and verification (operator 3).

Each shingle is a Poisson process whose rate is its weight; every arrival falls in a random register, and a register
keeps the shingle that arrives first.  Two documents agree in a register with the probability Jaccard similarity of
their weights.  A document is done as soon as no process can arrive before its latest register.  Each distinct shingle
weighs 1 however often it stands in the document, so that this similarity is the one that links are verified by.

Documents of equal bands meet in buckets.  There each is compared with the bucket's first document only; most buckets
are then one component.  In the others, documents outside the bucket's main component are compared with all of it:
in pairs if the bucket is small, else in tasks that hold a bounded part of it and return links that join what they
found, not all pairs.  Links count if the exact Jaccard similarity of the shingle sets reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import blocks
from offerlens.llm.digest import BASE_A, BASE_B, mix, prefix, span
from offerlens.llm.repeats import word_spans
from offerlens.llm.shared import components, cut

SHINGLE, SIMILAR = 5, 0.8
#: 40 bands of 6 registers miss a pair of similarity 0.8 with a probability of 5e-6.
BANDS, ROWS = 40, 6
#: Buckets of more documents are compared inside tasks, in parts of PART documents.
SMALL, PART = 16, 512
#: Characters of texts that are hashed together.
CHUNK = 4 << 20


class Texts:
    """Stands for a block: the bytes of some texts and where each ends."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum([len(r) for r in raw]).astype(np.int64)


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle digest, times) of the distinct shingles of each text, in order of both.

    A text of fewer words than a shingle has its whole word sequence as its only shingle; one without words has none.
    """
    t = Texts(texts)
    at, end = word_spans(t)
    pre = prefix(t.bytes.astype(np.uint64) + np.uint64(1))
    words = mix(span(pre, at, end) + (end - at).astype(np.uint64) * np.uint64(BASE_B))
    stop = np.searchsorted(at, t.ends)
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), stop - start)
    first = np.arange(len(words))
    last = np.minimum(first + size, stop[doc])
    whole = (last - first == size) | (first == start[doc])
    pre, first, last, doc = prefix(words), first[whole], last[whole], doc[whole]
    h = mix(span(pre, first, last) + (last - first).astype(np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def signatures(n: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signatures of n documents, given as (document, element, weight) triples; 0 where there is no element."""
    first, who = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    time, k = np.zeros(len(h)), 0
    while len(h):
        r = mix(h + np.uint64((2 * k + 1) * BASE_A % 2**64))
        time = time - np.log(((r >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / weight
        at = doc * registers + (mix(r + np.uint64(BASE_B)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = h[won]
        still = time < first.reshape(n, registers).max(1)[doc]
        doc, h, weight, time, k = doc[still], h[still], weight[still], time[still], k + 1
    return who.reshape(n, registers)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, set_digest, n, bands): the digest of the whole shingle set, its size, and a key for each band."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunked(frames, "text", CHUNK):
            n = len(frame)
            doc, h, _ = shingles(frame["text"].tolist())
            size = np.bincount(doc, minlength=n)
            sig = signatures(n, doc, h, np.ones(len(h)), BANDS * ROWS).reshape(n * BANDS, ROWS)
            keys = mix(prefixed(sig) + np.tile(np.arange(BANDS, dtype=np.uint64), n)).view(np.int64).reshape(n, BANDS)
            one, two = (np.zeros(n, np.uint64) for _ in range(2))
            np.add.at(one, doc, mix(h))
            np.add.at(two, doc, mix(h ^ np.uint64(BASE_B)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "one": one.view(np.int64), "two": two.view(np.int64), "n": size, "bands": list(keys)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, one long, two long, n long, bands array<long>")


def prefixed(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out = mix(out * np.uint64(BASE_A) + rows[:, i])
    return out


def chunked(frames: Iterator[pd.DataFrame], text: str, limit: int) -> Iterator[pd.DataFrame]:
    """The rows of frames, in frames of about limit characters at most."""
    for frame in frames:
        part = np.cumsum([len(t or "") for t in frame[text]]) // limit
        for _, own in frame.groupby(part, sort=False):
            yield own.reset_index(drop=True)


def sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles): the sorted digests of each document, as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunked(frames, "text", CHUNK):
            doc, h, _ = shingles(frame["text"].tolist())
            parts = np.split(h, np.searchsorted(doc, np.arange(1, len(frame))))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "shingles": [p.tobytes() for p in parts]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, shingles binary")


def verified(pairs: DataFrame, held: DataFrame, similar: float) -> DataFrame:
    """(a, b) of the pairs whose shingle sets are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                got.append(both / max(1, len(p) + len(q) - both) >= similar)
            yield frame.loc[np.array(got, bool), ["a", "b"]]

    x, y = held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def crossed(left: DataFrame, held: DataFrame, similar: float, most: int) -> DataFrame:
    """(a, b): links across components in crowded buckets, as a forest for each part.

    left has key, doc, root, main, size and outsiders.  A bucket is dealt into parts of about `most` documents and its
    outsiders, those not of the main component, into chunks of as many; each task holds one chunk against one part.  So
    a bucket of any size is compared whole, insiders are not copied where there is one chunk of outsiders, and no task
    holds more than about twice `most` documents.
    """

    def run(key, frame):
        sets_ = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        size = np.array([len(x) for x in sets_])
        _, ids = np.unique(np.concatenate(sets_), return_inverse=True)
        starts = np.cumsum(size) - size
        doc, root, asks = frame["doc"].to_numpy(), frame["root"].to_numpy(), frame["asks"].to_numpy(bool)
        held = np.flatnonzero(~asks)
        if not len(held):
            return pd.DataFrame([], columns=["a", "b"])
        inner = np.concatenate([ids[starts[j] : starts[j] + size[j]] for j in held])
        edges = np.cumsum(size[held]) - size[held]
        seen, up, out = np.zeros(int(ids.max()) + 1, bool), {}, []

        def top(i):
            while up.get(i, i) != i:
                i = up[i]
            return i

        for i in np.flatnonzero(asks):
            fits = (root[held] != root[i]) & (np.minimum(size[held], size[i]) >= similar * np.maximum(size[held], size[i]) - 1e-9)
            if not fits.any():
                continue
            own = ids[starts[i] : starts[i] + size[i]]
            seen[own] = True
            both = np.add.reduceat(seen[inner].astype(np.int64), edges)
            seen[own] = False
            for j in held[fits & (both / (size[i] + size[held] - both) >= similar)]:
                if (x := top(doc[i])) != (y := top(doc[j])):
                    up[x] = y
                    out.append((doc[i], doc[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    dealt = left.withColumns({"parts": F.ceil(F.col("size") / most).cast("int"), "chunks": F.ceil(F.col("outsiders") / most).cast("int")})
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    insiders = dealt.select("key", "doc", "root", share("parts", "doc", "key").alias("part"), number("chunks").alias("chunk"), F.lit(False).alias("asks"))
    outside = dealt.where("root <> main").select("key", "doc", "root", number("parts").alias("part"), share("chunks", "key", "doc").alias("chunk"), F.lit(True).alias("asks"))
    return insiders.unionByName(outside).join(held.withColumnRenamed("doc_id", "doc"), "doc").groupBy("key", "part", "chunk").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, part: int = PART) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), kept (it is that one).

    Classes are the components of links: Jaccard similarity of the sets of five-word shingles of at least `similar`,
    words being runs without blanks and ASCII controls 9 to 13, unchanged.  Texts of the same shingle set are one
    class.  Null, empty and wordless texts are each alone.  Rows that repeat an id share its class.  A null id has a
    null class and is kept.  An empty table gives an empty result.
    """
    held = cut(sketch(docs, id_col, text_col))
    worded = held.where("n > 0 AND doc_id IS NOT NULL")
    reps = cut(worded.groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    rows = reps.select(F.col("rep").alias("doc"), "n", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = cut(rows.join(heads, "key"))
    fits = lambda n, m: (F.least(n, m) >= F.greatest(n, m) * similar - 1e-9)  # noqa: E731  else the sets can't be similar enough
    met = rows.select(F.col("doc").alias("doc_id")).distinct()
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(met, "doc_id", "left_semi")
    shingle_sets = cut(sets(asked, "doc_id", "text").dropDuplicates(["doc_id"]))
    star = rows.where((F.col("doc") != F.col("head.doc")) & fits(F.col("n"), F.col("head.n"))).select(F.col("head.doc").alias("a"), F.col("doc").alias("b")).distinct()
    links = cut(verified(star, shingle_sets, similar))
    root = components(links)
    # buckets that are not one component yet
    named = rows.select("key", "doc", "n", "size").join(root.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    main = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("times")).groupBy("key").agg(F.max_by("root", F.struct("times", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), (F.sum("times") - F.max("times")).alias("outsiders"))
    left = cut(named.join(main.where("roots > 1").select("key", "main", "outsiders"), "key"))
    x = left.where((F.col("root") != F.col("main")) & (F.col("size") <= small)).select("key", F.col("doc").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"))
    y = left.where(F.col("size") <= small).select("key", F.col("doc").alias("y"), F.col("n").alias("n_y"), F.col("root").alias("root_y"))
    across = x.join(y, "key").where((F.col("root_x") != F.col("root_y")) & fits(F.col("n_x"), F.col("n_y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = links.unionByName(verified(across, shingle_sets, similar)).unionByName(crossed(left.where(F.col("size") > small), shingle_sets, similar, part))
    root = components(more)
    member = worded.select("doc_id", "one", "two", "n").join(reps.select("one", "two", "n", "rep"), ["one", "two", "n"])
    member = member.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    alone = held.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return member.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
