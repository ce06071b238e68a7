"""Removal of passages that occur more than once, over the whole corpus (operators 1 and 6).

A passage is a window of so many symbols (bytes or words) of one document.  One gram of each window owns it, chosen by
the window's content alone, so equal windows are owned by equal grams at equal places, and only texts around equal
grams are compared across documents:

1. each block sends its distinct grams that own windows; those that stand once in the corpus are done with;
2. for the others it sends its distinct snippets, the text of all windows that a gram owns, to the partition of the
   gram's hash.  There a suffix sort finds the windows with an earlier occurrence (bytes), or the suffix automaton of a
   gram's snippets those with any other (words);
3. the spans found go back to the blocks, which take them out of the text.

Hashes only propose: the suffix sort is verified by the bytes, automata compare words, and snippets of one block count
as equal only if their symbols are.  A gram with more snippets than the group limit (a line that very many texts share,
each going on differently) is not searched in one task: its windows are grouped by their own text instead.  Of the rows
keyed by a gram or a window's text, one is sent for each block of 2 MB that has it, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.llm import blocks, suffixes
from offerlens.llm.automaton import Automaton
from offerlens.llm.digest import BASE_A, BASE_B, mix, owners, prefix, span

#: Rows of a partition that are searched together, besides the last group's.
SEARCH_ROWS = 20_000
BLANK = re.compile(rb"[\x20\x09-\x0D]+")
UNEVEN = re.compile(rb"[\x09-\x0D]|  ").search


@dataclass(frozen=True)
class Passages:
    """What counts as a passage: symbols a window, symbols a gram, whether symbols are words, and whether the first occurrence stays."""

    window: int
    gram: int
    words: bool
    first_stays: bool
    group_limit: int = 2000
    block_bytes: int = 2 << 20
    #: Window starts of a block that are hashed together: the hash arrays take some dozens of bytes for each, so a long
    #: document goes through in overlapping segments.
    segment: int = 1 << 19


BYTES = Passages(window=100, gram=32, words=False, first_stays=True)
WORDS = Passages(window=35, gram=12, words=True, first_stays=False)


class Layout:
    """Where the symbols of a block and of its documents stand."""

    def __init__(self, b: blocks.Block, kind: Passages):
        self.block, self.kind = b, kind
        if kind.words:
            self.word_at, self.word_end = word_spans(b)
            self.n, self.ends = len(self.word_at), np.searchsorted(self.word_at, b.ends)
        else:
            self.n, self.ends = len(b.bytes), b.ends
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def symbols(self, a: int, b: int) -> np.ndarray:
        if not self.kind.words or a >= b:
            return self.block.bytes[a:b].astype(np.uint64) + np.uint64(1)
        start, end = self.word_at[a:b] - self.word_at[a], self.word_end[a:b] - self.word_at[a]
        pre = prefix(self.block.bytes[self.word_at[a] : self.word_end[b - 1]].astype(np.uint64) + np.uint64(1))
        return mix(span(pre, start, end) + (end - start).astype(np.uint64) * np.uint64(BASE_B))

    def raw(self, a: int, b: int) -> bytes:
        """The bytes of symbols a to b; words are joined by one space."""
        if not self.kind.words:
            return self.block.bytes[a:b].tobytes()
        raw = self.block.bytes[self.word_at[a] : self.word_end[b - 1]].tobytes()
        return b" ".join(BLANK.split(raw)) if UNEVEN(raw) else raw

    def segments(self) -> Iterator[Symbols]:
        """Parts of the symbols such that each window starts in one of them."""
        for a in range(0, max(self.n, 1), self.kind.segment):
            yield Symbols(self, a, min(self.n, a + self.kind.segment + self.kind.window - 1))


class Symbols:
    """The grams of a segment that own windows, and their classes of equal snippets.  Places count from the block's start."""

    def __init__(self, at: Layout, low: int, high: int):
        self.layout = at
        symbols = at.symbols(low, high)
        gram_at, first, last, self.hash, self.pre = owners(symbols, at.ends - low, at.kind.gram, at.kind.window)
        self.pre_b = prefix(symbols, BASE_B)
        snippet = self.digest(first, last + at.kind.window)
        self.at, self.lo, self.hi = gram_at + low, first + low, last + at.kind.window + low
        self.doc = np.searchsorted(at.ends, self.lo, side="right")
        self.classes(mix(self.hash + mix(snippet + (self.at - self.lo).astype(np.uint64)) * np.uint64(BASE_B)))

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(span(self.pre, a, b) + np.uint64(BASE_A) * mix(span(self.pre_b, a, b, BASE_B) + (b - a).astype(np.uint64)))

    def content(self, i: int) -> tuple[int, bytes]:
        return int(self.at[i] - self.lo[i]), self.layout.raw(int(self.lo[i]), int(self.hi[i]))

    def classes(self, digests: np.ndarray) -> None:
        """first: of each class the gram of least id and place, as documents are in order; times: its size; own_class: each gram's."""
        _, self.first, self.own_class, self.times = np.unique(digests, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(self.first[self.own_class] != np.arange(len(digests))) if len(digests) else digests
        if any(self.content(i) != self.content(j) for i, j in zip(again.tolist(), self.first[self.own_class[again]].tolist(), strict=True)):  # digests collided
            number: dict = {}
            self.own_class = np.array([number.setdefault(self.content(i), len(number)) for i in range(len(digests))])
            _, self.first, self.times = np.unique(self.own_class, return_index=True, return_counts=True)

    def places(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id and place in it."""
        return self.layout.block.ids[doc], at - self.layout.starts[doc]


def word_spans(b: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a block start and end; words never cross documents."""
    inner = np.zeros(len(b.bytes) + 2, bool)
    inner[1:-1] = ~((b.bytes == 0x20) | ((b.bytes >= 0x09) & (b.bytes <= 0x0D)))
    starts, ends = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    edges = b.ends[(b.ends > 0) & (b.ends < len(b.bytes))]
    starts[edges] |= inner[1:-1][edges]
    ends[edges - 1] |= inner[1:-1][edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


FOUND = "block long, at long, before int, after int"


def spans(docs: DataFrame, kind: Passages, id_col: str, text_col: str, key_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks, and (block, at, before, after): symbols at-before to at+after of the block are to go."""
    held = blocks.packed(docs, id_col, text_col, kind.block_bytes, key_col)
    seen = blocks.each(held, lambda block, b: ask(block, Layout(b, kind)), "h long, block long, n int, c int")
    w = W.partitionBy("h")
    live = seen.select("h", "block", F.sum("n").over(w).alias("n"), (F.sum("c").over(w) > kind.group_limit).alias("crowded")).where("n > 1").select("block", "h", "crowded")
    told = blocks.answered(held, live, lambda block, b, own: tell(block, Layout(b, kind), own), TOLD)
    dealt = told.repartition(blocks.partitions(docs.sparkSession), "h").sortWithinPartitions("h")
    found = dealt.mapInPandas(lambda frames: search(frames, kind), FOUND)
    crowded = blocks.answered(held, live.where("crowded"), lambda block, b, own: windows(block, Layout(b, kind), own), WINDOWS, all_blocks=False)
    return held, found.unionByName(repeated_windows(crowded, kind))


def ask(block: int, at: Layout) -> Iterator[pd.DataFrame]:
    """Each gram of the block once: how often it owns windows there, and how many snippets it has."""
    got = [(s.hash, s.hash[s.first]) for s in at.segments()]
    h, n = np.unique(np.concatenate([x for x, _ in got]), return_counts=True)
    _, c = np.unique(np.concatenate([x for _, x in got]), return_counts=True)
    yield pd.DataFrame({"h": h.view(np.int64), "block": block, "n": n.astype(np.int32), "c": c.astype(np.int32)})


TOLD = "h long, block long, at long, doc long, pos long, n int, before int, snippet binary"
WINDOWS = "block long, at long, doc long, pos long, n int, after int, snippet binary"


def among(hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    asked = np.sort(asked.astype(np.int64).view(np.uint64))
    place = np.minimum(np.searchsorted(asked, hashes), max(0, len(asked) - 1))
    return asked[place] == hashes if len(asked) else np.zeros(len(hashes), bool)


def tell(block: int, at: Layout, live: pd.DataFrame) -> pd.DataFrame:
    """The snippets of the grams asked for, one of each class, but for crowded grams."""
    asked, out = live["h"].to_numpy()[~live["crowded"].to_numpy(bool)], []
    for s in at.segments():
        keep = among(s.hash[s.first], asked)
        rep = s.first[keep]
        doc, pos = s.places(s.at[rep], s.doc[rep])
        text = [at.raw(a, b) for a, b in zip(s.lo[rep].tolist(), s.hi[rep].tolist(), strict=True)]
        out.append(pd.DataFrame({"h": s.hash[rep].view(np.int64), "block": block, "at": s.at[rep], "doc": doc, "pos": pos, "n": s.times[keep].astype(np.int32), "before": (s.at[rep] - s.lo[rep]).astype(np.int32), "snippet": text}))
    return pd.concat(out)


def windows(block: int, at: Layout, live: pd.DataFrame) -> pd.DataFrame:
    """The windows of crowded grams, each text once with the place of the first.

    Further places are known to go: they have no text, and those that meet are one row up to where the last one ends.
    """
    size, out, texts, again = at.kind.window, [], {}, []
    for s in at.segments():
        for i in np.flatnonzero(among(s.hash[s.first], live["h"].to_numpy())).tolist():
            rep = s.first[i]
            for a in range(int(s.lo[rep]), int(s.hi[rep]) - size + 1):
                texts.setdefault(at.raw(a, a + size), []).append((a, int(s.doc[rep]), int(s.times[i])))
    for text, places in texts.items():
        places.sort()
        a, d, _ = places[0]
        n = sum(p[2] for p in places)
        out.append((block, a, int(at.block.ids[d]), a - int(at.starts[d]), n, size, text))
        again += [(a, a + size - 1) for a, _, _ in places[1:]]
    out += [(block, a, 0, 0, 0, b + 1 - a, None) for a, b in merged(again)]
    return pd.DataFrame(out, columns=[c.split(" ")[0] for c in WINDOWS.split(", ")])


def repeated_windows(rows: DataFrame, kind: Passages) -> DataFrame:
    """Spans of windows with an earlier occurrence, or with any other, grouped by their text; a text has one row a block."""
    place = F.struct("doc", "pos", "block", "at")
    # rows without a text go in any case: each is a group of its own, in the same pass
    w = W.partitionBy(F.coalesce("snippet", F.encode(F.concat_ws("-", "block", "at"), "UTF-8")))
    seen = rows.withColumns({"place": place, "first": F.min(place).over(w), "total": F.sum("n").over(w)})
    again = (F.col("total") > 1) & (F.col("place") != F.col("first")) if kind.first_stays else F.col("total") > 1
    return seen.where(F.col("snippet").isNull() | again).select("block", "at", F.lit(0).alias("before"), "after")


def whole_groups(frames: Iterator[pd.DataFrame], key: str, least: int) -> Iterator[pd.DataFrame]:
    """The rows of frames that are in order of the key, in frames of about so many rows that hold whole groups."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        while len(frame):
            part, frame = frame.iloc[:least], frame.iloc[least:]
            if n >= least:  # what comes before the last group of what is held can go
                rows = pd.concat(held, ignore_index=True)
                k = rows[key].to_numpy()
                cut = int(np.searchsorted(k, k[-1]))
                if cut:
                    yield rows.iloc[:cut].reset_index(drop=True)
                held, n = [rows.iloc[cut:]], len(rows) - cut
            held.append(part)
            n += len(part)
    if n:
        yield pd.concat(held, ignore_index=True)


def search(frames: Iterator[pd.DataFrame], kind: Passages) -> Iterator[pd.DataFrame]:
    """Spans that are to go, from the rows of a partition in order of h, some SEARCH_ROWS at a time; groups keep to the group limit."""
    for rows in whole_groups(frames, "h", SEARCH_ROWS):
        yield (earlier if kind.first_stays else anywhere)(rows.sort_values(["h", "doc", "pos", "block", "at"], ignore_index=True), kind)


def earlier(rows: pd.DataFrame, kind: Passages) -> pd.DataFrame:
    """Spans of snippets whose windows also occur in a snippet further up in its group, by suffix sorts to both sides.

    A window that holds the gram and l symbols before it occurs in both of two snippets if they share l symbols to the
    left and window - l from the gram's start to the right.  The common extensions of suffix-sorted neighbours tell,
    for each l, which snippets do.
    """
    n, reach = len(rows), kind.window - kind.gram
    symbols = np.frombuffer(b"".join(rows["snippet"]), np.uint8)
    sizes = rows["snippet"].map(len).to_numpy(np.int64)
    at = np.cumsum(sizes) - sizes + rows["before"].to_numpy(np.int64)
    left, right = rows["before"].to_numpy(np.int64), sizes - rows["before"].to_numpy(np.int64)
    h = rows["h"].to_numpy()
    edge = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    stop = np.append(np.flatnonzero(edge), n)[np.cumsum(edge)]
    r_order, r_common = suffixes.sort(symbols, at, right, start, stop)
    l_order, l_common = suffixes.sort(symbols[::-1].copy(), len(symbols) - 1 - (at + kind.gram - 1), left + kind.gram, start, stop)
    found = np.zeros((n, reach + 2), bool)
    r_node, l_node = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(reach + 1):
        r_node[r_order] = np.cumsum(r_common < kind.window - k)
        l_node[l_order] = np.cumsum(l_common < kind.gram + k)
        whole = np.flatnonzero((left >= k) & (right >= kind.window - k))
        if len(whole):
            _, first, node = np.unique(r_node[whole] * np.int64(n + 1) + l_node[whole], return_index=True, return_inverse=True)
            found[whole, k] = first[node] != np.arange(len(whole))  # rows are in order, so the first is the earliest
    rise = np.flatnonzero(found[:, 0]), np.argwhere(found[:, 1:] & ~found[:, :-1])
    i = np.concatenate([rise[0], rise[1][:, 0]])
    low = np.concatenate([np.zeros(len(rise[0]), np.int64), rise[1][:, 1] + 1])
    falls = np.argwhere(found[:, :-1] & ~found[:, 1:])  # ordered by row and place, as the rises are once sorted
    order = np.lexsort((low, i))
    i, low, high = i[order], low[order], falls[:, 1]
    return pd.DataFrame({"block": rows["block"].to_numpy()[i], "at": rows["at"].to_numpy()[i], "before": high, "after": kind.window - low})


def anywhere(rows: pd.DataFrame, kind: Passages) -> pd.DataFrame:
    """Spans of snippets that occur at least twice, by the suffix automaton of each group.

    Each snippet has a mark where its gram starts: what occurs twice holds the gram at the same place, and all windows
    of a snippet hold it.
    """
    out: list[tuple[int, int, int, int]] = []
    h = rows["h"].to_numpy()
    edges = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
    own = [rows[c].tolist() for c in ("snippet", "before", "n", "block", "at")]  # most groups have two rows: no frame for each
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        snippets, befores, ns, group_blocks, ats = (c[lo:hi] for c in own)
        times: dict[tuple[bytes, int], int] = {}
        for text, before, n in zip(snippets, befores, ns, strict=True):
            times[text, before] = times.get((text, before), 0) + n
        found: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
        if len(times) == 1:  # one snippet, more than once: all of it
            ((text, before), n), *_ = times.items()
            size = text.count(b" ") + 1
            found[text, before] = [(0, size)] if size >= kind.window and n > 1 else []
        else:
            texts = {}
            for text, before in times:
                words = text.split(b" ")
                texts[text, before] = [*words[:before], None, *words[before:]]
            a = Automaton()
            for t, words in texts.items():
                a.add(words, times[t])
            a.close()
            for t, words in texts.items():
                found[t] = merged([(i + 1 - m, i) for i, m in enumerate(a.repeated(words)) if m > kind.window and i + 1 - m <= t[1] <= i])
        for text, block, at, before in zip(snippets, group_blocks, ats, befores, strict=True):
            out += [(block, at, before - a, b - before) for a, b in found[text, before]]
    return pd.DataFrame(out, columns=["block", "at", "before", "after"])


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered(at: Layout, found: pd.DataFrame) -> np.ndarray:
    """Which symbols of the block go: the spans that came back, and the snippets that a segment has more than once."""
    delta = np.zeros(at.n + 1, np.int64)
    place = found["at"].to_numpy(np.int64)
    np.add.at(delta, place - found["before"].to_numpy(np.int64), 1)
    np.add.at(delta, place + found["after"].to_numpy(np.int64), -1)
    for s in at.segments():
        again = s.times[s.own_class] > 1 if len(s.at) else np.zeros(0, bool)
        if at.kind.first_stays:
            again[s.first] = False
        np.add.at(delta, s.lo[again], 1)
        np.add.at(delta, s.hi[again], -1)
    return np.cumsum(delta[:-1]) > 0


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, kind: Passages = BYTES, key_col: str | None = None) -> DataFrame:
    """Documents without the bytes of any 100-byte string that also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start; of rows with the same id the one of smaller
    key, or first read without a key_col, counts as earlier.  Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (lowercase hex) and, if asked for, kept: the remaining bytes as text, parts of cut
    characters left out; with a key_col also row_key.  Null and empty texts have 0 bytes.  A text longer than a block is
    a block of its own and is hashed in segments.  An empty table gives an empty result; other columns are not read.
    """

    def cut(block: int, b: blocks.Block, found: pd.DataFrame) -> pd.DataFrame:
        at = Layout(b, kind)
        gone, rows = covered(at, found), []
        for i, (doc, x, y) in enumerate(zip(b.doc_ids(), b.starts.tolist(), b.ends.tolist(), strict=True)):
            own = gone[x:y]
            kept = b.bytes[x:y][~own].tobytes()
            n_spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            rows.append((doc, y - x, int(own.sum()), n_spans, hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "ignore"),) if with_text else ()) + ((int(b.keys[i]),) if key_col else ()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text + ["row_key"] * bool(key_col))

    held, found = spans(docs, kind, id_col, text_col, key_col)
    return blocks.answered(held, found, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text + ", row_key long" * bool(key_col))


def without_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, kind: Passages = WORDS) -> DataFrame:
    """Documents without the words of any 35-word sequence that also starts anywhere else.

    Words are runs of other characters than blanks and ASCII controls 9 to 13, unchanged.  Returns doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for, kept (those words).  All copies
    go, the first too.  Null and empty texts have no words.  A text longer than a block is a block of its own and is
    hashed in segments.  An empty table gives an empty result; repeated rows are copies of each other; other columns
    are not read.
    """

    def cut(block: int, b: blocks.Block, found: pd.DataFrame) -> pd.DataFrame:
        at = Layout(b, kind)
        gone, rows = covered(at, found), []
        for doc, x, y in zip(b.doc_ids(), at.starts.tolist(), at.ends.tolist(), strict=True):
            edges = (np.flatnonzero(np.diff(gone[x:y].astype(np.int8), prepend=1, append=1)) + x).tolist()
            kept = b" ".join([at.raw(i, j) for i, j in zip(edges[::2], edges[1::2], strict=True)])  # runs of words that stay
            rows.append((doc, y - x, int(gone[x:y].sum()), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    held, found = spans(docs, kind, id_col, text_col)
    return blocks.answered(held, found, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
