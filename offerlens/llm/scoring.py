"""Stupid-backoff language-model scores from count tables partitioned by hash (operator 8).

Each block of documents is exploded into its distinct n-grams with their counts there.  Dealt into parts by the
n-gram's hash, their sums over all blocks are the count table, joined to what was asked: each block gets the counts of
its own n-grams back, looks them up for every word, and sums the scores per document.  There are as many parts as the
size of all texts asks for, so a part's share of the table is bounded whatever the input; what a block has of a part
travels as one compressed row, as a row for each n-gram takes several times the space.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from offerlens.llm import blocks
from offerlens.llm.digest import BASE_A, BASE_B, mix
from offerlens.llm.repeats import WORDS, Layout

#: Words an n-gram, the factor of each step back, and the least count with which an n-gram of several words is used.
ORDER, BACKOFF, LEAST = 2, 0.4, 2
START = np.uint64(0x5D588B656C078965)
#: Words hashed together.
PIECE = 1 << 18


class Grams:
    """The n-grams of a block's documents, each document led by order - 1 start marks."""

    def __init__(self, b: blocks.Block, order: int):
        layout = Layout(b, WORDS)
        self.sizes = np.diff(np.concatenate([[0], layout.ends]))
        words = np.concatenate([layout.symbols(a, min(a + PIECE, layout.n)) for a in range(0, max(layout.n, 1), PIECE)])
        lead = order - 1
        del layout
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.at = np.arange(len(words), dtype=np.int32) + (self.doc + 1) * np.int32(lead)  # of each word among words and marks
        stream = np.empty(len(words) + lead * len(self.sizes), np.uint64)
        stream[self.at] = words
        first = np.cumsum(self.sizes + lead) - (self.sizes + lead)
        for k in range(lead):  # the k-th mark is a symbol of its own, so no n-gram across documents looks like one inside
            stream[first + k] = START + np.uint64(k)
        #: Digests of the n-grams that end at each place, for n from 1 to order, and from which place of a document on
        #: they are its own.
        self.by_n, self.place = [stream], np.arange(len(stream), dtype=np.int32) - np.repeat(first.astype(np.int32), self.sizes + lead)
        for n in range(2, order + 1):
            before = np.concatenate([np.zeros(1, np.uint64), self.by_n[-1][:-1]])[: len(stream)]
            self.by_n.append(mix(before * np.uint64(BASE_A) + stream * np.uint64(BASE_B) + np.uint64(n)))

    def counted(self):
        """Digests of the distinct n-grams, their counts, and which n less one each has."""
        got = [np.unique(digests[self.place >= n], return_counts=True) for n, digests in enumerate(self.by_n)]
        return np.concatenate([h for h, _ in got]), np.concatenate([c for _, c in got]), np.repeat(np.arange(len(got), dtype=np.int8), [len(h) for h, _ in got])

    def dealt(self, parts: int):
        """(part, ascending digests, counts, n less one) of the parts by hash that have any."""
        h, c, n = self.counted()
        part = (mix(h) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((h, part))
        h, c, n, part = h[order], c[order], n[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
        for a, z in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist(), strict=True):
            yield int(part[a]), h[a:z], c[a:z], n[a:z]


def planes(h: np.ndarray) -> np.ndarray:
    """Ascending digests as differences, byte by byte, which compresses."""
    return np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def unplaned(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs over all words), n_backoff (words scored without context).

    A word after its context scores count(context, word) / count(context) if the n-gram occurs `least` times or more,
    at least twice: one that occurs once is known from this very text alone.  Else it scores `backoff` times its score
    after the shorter context, at last its share of all words.  Counts are over all documents.  Words are runs without
    blanks and ASCII controls 9 to 13, unchanged; start marks lead a document.  Null, empty and wordless texts have
    n_words 0 and log_score 0.  Repeated rows count as often as they stand there.  An empty table gives an empty
    result; other columns are not read.  A text longer than a block is a block of its own.
    """
    if least < 2:
        raise ValueError("least must be 2 or more: every n-gram of a text occurs once")
    parts = blocks.parts_of(docs, text_col)
    held = blocks.packed(docs, id_col, text_col)

    def explode(block: int, b: blocks.Block):
        g = Grams(b, order)
        rows = [(block, -1, len(g.at), b"")]  # how many words the block has
        for part, h, n, _ in g.dealt(parts):
            rows.append((block, part, 0, blocks.squeeze(planes(h), n.astype(np.uint32))))
        yield pd.DataFrame(rows, columns=["block", "part", "words", "grams"])

    def count(key, rows):
        if key[0] < 0:
            return pd.DataFrame({"block": rows["block"], "part": key[0], "words": int(rows["words"].sum()), "counts": b""})
        got = [blocks.spread(x, np.uint8, np.uint32) for x in rows["grams"]]
        lists, times = [unplaned(x[0]) for x in got], [x[1] for x in got]
        _, own = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(own, weights=np.concatenate(times)).astype(np.uint32)[own]
        edges = np.cumsum([len(x) for x in lists])[:-1]
        return pd.DataFrame({"block": rows["block"], "part": key[0], "words": 0, "counts": [blocks.squeeze(x) for x in np.split(total, edges)]})

    def join(block: int, b: blocks.Block, answers: pd.DataFrame) -> pd.DataFrame:
        g = Grams(b, order)
        of = dict(zip(answers["part"], answers["counts"], strict=True))
        table = [(h, blocks.spread(of[part], np.uint32)[0], n) for part, h, _, n in g.dealt(parts)]
        levels = []
        for n in range(order):
            h = np.concatenate([x[0][x[2] == n] for x in table]) if table else np.empty(0, np.uint64)
            c = np.concatenate([x[1][x[2] == n] for x in table]) if table else np.empty(0, np.uint32)
            by = np.argsort(h)
            levels.append((h[by], c[by].astype(np.float64)))
        counts = lambda n, h: levels[n - 1][1][np.searchsorted(levels[n - 1][0], h)]
        words = max(1, int(answers["words"].max()))
        value = np.log(counts(1, g.by_n[0][g.at]) / words) + (order - 1) * np.log(backoff)
        back = np.ones(len(g.at), bool)
        for n in range(2, order + 1):
            c = counts(n, g.by_n[n - 1][g.at])
            hit = c >= least
            value[hit] = np.log(c[hit] / counts(n - 1, g.by_n[n - 2][g.at[hit] - 1])) + (order - n) * np.log(backoff)
            back &= ~hit
        n_docs = len(b.ids)
        return pd.DataFrame({"doc_id": pd.array(b.doc_ids(), "Int64"), "n_words": g.sizes, "log_score": np.bincount(g.doc, weights=value, minlength=n_docs), "n_backoff": np.bincount(g.doc, weights=back, minlength=n_docs).astype(np.int64)})

    exploded = blocks.each(held, explode, "block long, part long, words long, grams binary")
    counted = exploded.groupBy("part").applyInPandas(count, "block long, part long, words long, counts binary")
    return blocks.answered(held, counted, join, "doc_id long, n_words long, log_score double, n_backoff long")
