"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (operator 5).

A text's paragraphs, long ones cut further at words their content picks, are hashed into a table of cells, each holding
a count, a sum of digests and a sum of check values.  A fingerprint is that table, of the least width (doubled until it
works out) from which all of the text's own digests can be peeled.  Tables of different widths fold onto the smaller.
Subtracting two tables cancels what two versions share; peeling cells of a single digest recovers those in which they
differ.  If too many differ, both are compared at twice the width, made anew from their own peeled digests beyond that,
until it works out.  So the likeness of two texts, and the digests lost and gained, follow from their fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.blocks import NO_ID, partitions
from offerlens.llm.digest import BASE_A, BASE_B, mix, prefix, span
from offerlens.llm.minhash import Texts
from offerlens.llm.repeats import word_spans

#: Least number of cells in each of the three parts of a fingerprint; a power of two.
WIDTH = 8
#: A word in so many ends a paragraph that is longer.
CUT = 16
#: Characters and rows of texts that are sketched together.
CHUNK_CHARS, CHUNK_ROWS = 2 << 20, 2000


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of each paragraph; the k-th equal one of a text has a digest of its own."""
    t = Texts(texts)
    at, end = word_spans(t)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pre = prefix(t.bytes.astype(np.uint64) + np.uint64(1))
    words = mix(span(pre, at, end) + (end - at).astype(np.uint64) * np.uint64(BASE_B))
    doc = np.searchsorted(t.ends, at, side="right")
    line = np.cumsum(t.bytes == 10)[at]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]) | (words[:-1] % np.uint64(CUT) == 0)]))
    last = np.append(first[1:], len(words))
    h, doc = mix(span(prefix(words), first, last) + (last - first).astype(np.uint64)), doc[first]
    order = np.lexsort((h, doc))
    sorted_h, sorted_doc = h[order], doc[order]
    new = np.concatenate([[True], (sorted_h[1:] != sorted_h[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])])
    place = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return sorted_doc, np.where(place > 0, mix(sorted_h + place.astype(np.uint64) * np.uint64(BASE_A)), sorted_h)


def slots(h: np.ndarray, width: int) -> np.ndarray:
    """The cell of each digest in each of the three parts."""
    return np.stack([(mix(h + np.uint64(BASE_B * (k + 1) % 2**64)) % np.uint64(width)).astype(np.int64) + k * width for k in range(3)], axis=1)


def tables(n: int, doc: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """(n, 3 * width, 3): count, digest sum and check sum of each cell, modulo 2**64."""
    out = np.zeros((n * 3 * width, 3), np.uint64)
    at = (doc[:, None] * (3 * width) + slots(h, width)).ravel()
    for i, value in enumerate((np.ones(len(h), np.uint64), h, mix(h ^ np.uint64(BASE_A)))):
        np.add.at(out[:, i], at, np.repeat(value, 3))
    return out.reshape(n, 3 * width, 3)


def peeled(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For differences of tables: (number, digest, whether on the left) of what was recovered, and whether that was all."""
    n, cells, _ = diff.shape
    flat = diff.reshape(n * cells, 3).copy()
    one, minus = np.uint64(1), np.uint64(2**64 - 1)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        at = np.flatnonzero((flat[:, 0] == one) | (flat[:, 0] == minus))
        sign = flat[at, 0]
        h = flat[at, 1] * sign
        pure = flat[at, 2] * sign == mix(h ^ np.uint64(BASE_A))
        pair, h, sign = at[pure] // cells, h[pure], sign[pure]
        if not len(pair):
            break
        _, i = np.unique(mix(h) + pair.astype(np.uint64) * np.uint64(BASE_B), return_index=True)
        pair, h, sign = pair[i], h[i], sign[i]
        got.append((pair, h, sign == one))
        to = (pair[:, None] * cells + slots(h, cells // 3)).ravel()
        for k, value in enumerate((sign, h * sign, mix(h ^ np.uint64(BASE_A)) * sign)):
            np.subtract.at(flat[:, k], to, np.repeat(value, 3))
    pair, h, left = (np.concatenate([g[k] for g in got]) if got else np.empty(0, kind) for k, kind in enumerate((np.int64, np.uint64, bool)))
    return pair, h, left, ~flat.reshape(n, cells, 3).any((1, 2))


def compared_sets(n_texts: int, doc: np.ndarray, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shared digests over all digests of texts x[i] and y[i], by subtracting and peeling; and (i, digest, whether in x) of the others."""
    size = np.bincount(doc, minlength=n_texts)
    out, todo, width = np.ones(len(x)), np.arange(len(x)), WIDTH
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(todo):
        used, own = np.unique(np.concatenate([x[todo], y[todo]]), return_inverse=True)
        place = np.full(n_texts, -1)
        place[used] = np.arange(len(used))
        held = place[doc] >= 0
        t = tables(len(used), place[doc[held]], h[held], width)
        pair, digest, in_x, ok = peeled(t[own[: len(todo)]] - t[own[len(todo) :]])
        left, right = np.bincount(pair[in_x], minlength=len(todo)), np.bincount(pair[~in_x], minlength=len(todo))
        shared = size[x[todo]] - left
        ok &= shared == size[y[todo]] - right
        whole = shared + left + right
        out[todo[ok]] = np.where(whole[ok] > 0, shared[ok] / np.maximum(whole[ok], 1), 1.0)
        good = ok[pair]
        found.append((todo[pair[good]], digest[good], in_x[good]))
        todo, width = todo[~ok], width * 2
    pair, digest, in_x = (np.concatenate([f[k] for f in found]) if found else np.empty(0, kind) for k, kind in enumerate((np.int64, np.uint64, bool)))
    return out, pair, digest, in_x


def own_tables(n_texts: int, doc: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """The table of each text, of the least width from which its own digests can be peeled."""
    size = np.bincount(doc, minlength=n_texts)
    out: list[np.ndarray] = [np.empty(0)] * n_texts
    need, width = np.arange(n_texts), WIDTH
    while len(need):
        todo = need[size[need] <= 3 * width]  # more digests than cells can't be peeled
        place = np.full(n_texts, -1)
        place[todo] = np.arange(len(todo))
        held = place[doc] >= 0
        t = tables(len(todo), place[doc[held]], h[held], width)
        ok = peeled(t)[3]
        for i in np.flatnonzero(ok).tolist():
            out[todo[i]] = t[i]
        place[todo[ok]] = -2
        need, width = need[place[need] != -2], width * 2
    return out


def written(table: np.ndarray, size: int, text: str) -> str:
    """A fingerprint: paragraphs, the cells (counts, digest and check sums), and a digest of the text itself."""
    cells = table[:, 0].astype("<i4").tobytes() + table[:, 1].astype("<u8").tobytes() + table[:, 2].astype("<u8").tobytes()
    return f"{size}:{base64.b64encode(cells).decode()}:{hashlib.blake2b(text.encode(), digest_size=8).hexdigest()}"


def digests_of(fingerprint: str) -> np.ndarray:
    """The paragraph digests of a text, peeled from its fingerprint."""
    raw = base64.b64decode(fingerprint.split(":")[1])
    n = len(raw) // 20
    table = np.stack([np.frombuffer(raw, "<i4", n).astype(np.int64).view(np.uint64), np.frombuffer(raw, "<u8", n, 4 * n), np.frombuffer(raw, "<u8", n, 12 * n)], axis=1)
    return peeled(table[None])[1]


def likeness(one: str, two: str) -> tuple[float, list[int], list[int]]:
    """How like two fingerprints are (0 to 1), and the digests that only the first and only the second has."""
    a, b = digests_of(one), digests_of(two)
    doc, h, first, second = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([0]), np.array([1])
    near, _, digest, in_first = compared_sets(2, doc, h, first, second)
    return float(near[0]), sorted(digest[in_first].view(np.int64).tolist()), sorted(digest[~in_first].view(np.int64).tolist())


def compared(ids: list, texts: list[str], after: str) -> pd.DataFrame:
    """The result rows for texts in order; after is the text that follows the last."""
    n, following = len(texts), [*texts[1:], after]
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
    doc, h = paragraphs([*texts, after, *edited])
    total, size, own = 2 * n + 1, np.bincount(doc, minlength=2 * n + 1), np.arange(n)
    near, pair, digest, in_x = compared_sets(total, doc, h, np.concatenate([own, own]), np.concatenate([own + n + 1, own + 1]))
    cells = own_tables(total, doc, h)
    sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    prints = [written(cells[i], int(size[i]), t) for i, t in enumerate([*texts, after, *edited])]
    order = np.lexsort((digest.view(np.int64), pair))
    pair, digest, in_x = pair[order], digest[order].view(np.int64), in_x[order]
    split = lambda on: [x.tolist() for x in np.split(digest[on], np.searchsorted(pair[on], np.arange(1, n)))]
    edits = pair < n
    return pd.DataFrame({
        "doc_id": pd.array([None if i == NO_ID else i for i in ids], "Int64"), "n_chars": [len(t) for t in texts], "edited_sha256": sha, "fingerprint": prints[:n], "edited_fingerprint": prints[n + 1 :],
        "near_edited": near[:n], "near_next": near[n:], "lost": split(edits & in_x), "gained": split(edits & ~in_x),
    })


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lost array<long>, gained array<long>"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like they are.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    document's, by ascending doc_id; the first document follows the last, so a lone document follows itself.  Likeness
    is the share of paragraphs in common, 1 for two texts without words.  lost and gained are the paragraph digests that
    only the text and only the edited text has.  Equal texts have equal fingerprints.  Null
    texts count as empty.  A null id sorts first; rows that repeat an id follow each other in any order.  An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10_000, 4 * n)))).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right")).astype("int32")

    bucket = range_of("doc_id")
    placed = rows.withColumn("bucket", bucket).withColumn("guest", F.lit(0))
    # the first document of each range also goes to the range before: one row a range
    firsts = sorted((r["bucket"], r["low"]) for r in rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("low")).collect())
    if not firsts:
        return spark.createDataFrame([], RESULT)
    before = [(low, firsts[i - 1][0]) for i, (_, low) in enumerate(firsts)]
    hosts = F.broadcast(spark.createDataFrame(before, "doc_id long, bucket int"))
    guests = rows.join(hosts, "doc_id").select("doc_id", "text", "bucket", F.lit(1).alias("guest"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, texts, size = None, [], [], 0
        for frame in frames:
            for b, guest, i, text in zip(frame["bucket"], frame["guest"], frame["doc_id"], frame["text"], strict=True):
                if ids and (guest or size > CHUNK_CHARS or len(ids) >= CHUNK_ROWS):
                    yield compared(ids, texts, text)
                    ids, texts, size = [], [], 0
                held = b
                if not guest:
                    ids.append(i)
                    texts.append(text)
                    size += len(text)
        assert not ids, f"range {held} has no follower"

    dealt = placed.unionByName(guests).repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id")
    return dealt.mapInPandas(run, RESULT)
