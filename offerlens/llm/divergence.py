"""How sources differ in their words: divergences of all pairs of sources of a language, and each source's own terms (operator 11).

Terms are counted in tasks, dealt by hash into chunks of the vocabulary, and summed there; a chunk then holds, for each
source, a packed vector of its counts.  Sources are dealt into blocks, and each vector is replicated to the tiles
(block by block) that its source takes part in.  A tile goes over successive chunks, adding to its submatrix of pairs;
tiles over different slabs of chunks run apart and are summed, so no task's work grows with the vocabulary.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.llm.blocks import spread, squeeze
from offerlens.llm.digest import mix, prefix, span
from offerlens.llm.shared import cut

#: Documents with a term for it to be kept; probabilities are parts of SCALE; terms reported of each source.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text that are counted together, and documents at most; bytes of all text for each chunk of the vocabulary.
COUNT_BYTES, COUNT_DOCS, CHUNK_BYTES = 8 << 20, 1 << 18, 4 << 20
#: Sources a block and chunks a slab.
BLOCK, SLAB = 16, 16
#: Counted (term, source) pairs that a chunk's merge gathers before it adds them up.
MERGE = 1 << 20

# Terms are runs of ASCII letters and of characters above ASCII; A to Z are lower-cased, other bytes part terms.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, each followed by one blank, and the number of the text that each is of."""
    raw = np.frombuffer(b" ".join(texts).translate(LOWERED) + b" ", np.uint8)
    inside = raw != 32
    before = np.concatenate([[False], inside[:-1]])
    ends = np.flatnonzero(before & ~inside)
    kept = raw[inside | before]
    offsets = np.concatenate([[0], np.flatnonzero(kept == 32) + 1]).astype(np.int32)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), ends)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), doc


def bytes_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of an array's terms begins, one more for the end, and the bytes."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, 4 * terms.offset).astype(np.int64)
    raw = np.frombuffer(terms.buffers()[2], np.uint8) if terms.buffers()[2] else np.empty(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def binary(sizes: np.ndarray, raw: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [len(x)]]) if len(x) else np.zeros(1, np.int64)


def counted(groups: list[tuple[str, str]], texts: list[bytes], chunks: int) -> Iterator[tuple]:
    """(lang, chunk, sources, packed terms with their counts and documents by source) of some documents."""
    terms, doc = terms_of(texts)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    number: dict = {}
    group_of = np.array([number.setdefault(g, len(number)) for g in groups], np.int64)
    key = np.sort((group_of[doc] * len(names) + code) * len(texts) + doc)
    run = edges(key // len(texts))
    at = key[run[:-1]] // len(texts)
    times = np.diff(run)
    docs = np.add.reduceat(np.concatenate([[True], key[1:] != key[:-1]]).astype(np.int64), run[:-1])
    group, code = at // len(names), at % len(names)
    offsets, raw = bytes_of(names)
    chunk = (mix(span(prefix(raw.astype(np.uint64)), offsets[:-1], offsets[1:])) % np.uint64(chunks)).astype(np.int64)
    langs = sorted({g[0] for g in number})
    known, lang_of = list(number), np.array([langs.index(g[0]) for g in number])
    order = np.lexsort((group, code, chunk[code], lang_of[group]))
    group, code, times, docs = group[order], code[order], times[order], docs[order]
    part = edges(lang_of[group] * chunks + chunk[code])
    for a, z in zip(part[:-1].tolist(), part[1:].tolist(), strict=True):
        of_term = edges(code[a:z])
        own = code[a:z][of_term[:-1]]
        sources, source = np.unique(group[a:z], return_inverse=True)
        sizes = offsets[own + 1] - offsets[own]
        letters = raw[np.repeat(offsets[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
        payload = squeeze(sizes.astype(np.uint32), letters, np.diff(of_term).astype(np.uint32), source.astype(np.uint32), times[a:z].astype(np.uint32), docs[a:z].astype(np.uint32))
        yield langs[int(lang_of[group[a]])], int(chunk[own[0]]), [known[g][1] for g in sources], payload


class Merge:
    """The terms of a chunk with their counts and documents by source, summed over what was counted apart."""

    def __init__(self):
        self.sources: dict[str, int] = {}
        self.parts, self.waiting = [], 0

    def add(self, sources: list[str], payload: bytes) -> None:
        sizes, raw, per_term, source, times, docs = spread(payload, np.uint32, np.uint8, np.uint32, np.uint32, np.uint32, np.uint32)
        mapped = np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)
        self.parts.append((binary(sizes, raw), np.repeat(np.arange(len(sizes)), per_term), mapped[source], times.astype(np.int64), docs.astype(np.int64)))
        self.waiting += len(source)
        if self.waiting > MERGE:
            self.sum()
            self.waiting = 0

    def sum(self):
        """One part: the distinct terms, and the entries by term and source."""
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        code, first = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *[len(p[0]) for p in self.parts]])
        term = np.concatenate([code[first[i] + p[1]] for i, p in enumerate(self.parts)])
        source, times, docs = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4))
        order = np.lexsort((source, term))
        key = term[order] * len(self.sources) + source[order]
        run = edges(key)[:-1]
        self.parts = [(coded.dictionary, term[order][run], source[order][run], np.add.reduceat(times[order], run), np.add.reduceat(docs[order], run))]
        return self.parts[0]

    def rows(self, lang: str, chunk: int) -> Iterator[tuple]:
        """(lang, source, chunk, n_terms, lead, total, vector, terms) of each source that has kept terms here."""
        names, term, source, times, docs = self.sum()
        spread_over = np.bincount(term, weights=docs, minlength=len(names))
        place, all_times = np.cumsum(spread_over >= LEAST_DOCS) - 1, np.zeros(len(names), np.int64)
        np.add.at(all_times, term, times)
        kept = spread_over[term] >= LEAST_DOCS
        term, source, times = term[kept], source[kept], times[kept]
        order = np.argsort(source, kind="stable")
        offsets, raw = bytes_of(names)
        n_terms, known = int((spread_over >= LEAST_DOCS).sum()), list(self.sources)
        cuts = edges(source[order])
        for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            own = order[a:z]
            t = term[own]
            sizes = offsets[t + 1] - offsets[t]
            letters = raw[np.repeat(offsets[t] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            vector = squeeze(np.diff(place[t], prepend=0).astype(np.uint32), times[own])
            yield lang, known[source[own[0]]], chunk, n_terms, n_terms if i == 0 else 0, int(times[own].sum()), vector, squeeze(all_times[t], sizes.astype(np.uint32), letters)


def sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield sent(held, schema)
            held = []
    if held:
        yield sent(held, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


COUNTED = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("sources", pa.list_(pa.string())), ("payload", pa.binary())])
VECTORS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("chunk", pa.int64()), ("n_terms", pa.int64()), ("lead", pa.int64()), ("total", pa.int64()), ("vector", pa.binary()), ("terms", pa.binary())])
SPARK = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SPARK[f.type]}" for f in schema)


def vectors(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, source, chunk, n_terms, lead, total, vector, terms): the counts of a source's kept terms in each chunk of its language's vocabulary.

    n_terms is how many the chunk keeps of the language, lead the same on one of the chunk's rows and 0 on the others.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-int(size) // chunk_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            groups, texts, held = [], [], 0
            for batch in batches:
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if texts and (held + len(text) > COUNT_BYTES or len(texts) == COUNT_DOCS):
                        yield from counted(groups, texts, chunks)
                        groups, texts, held = [], [], 0
                    groups.append((lang, source))
                    texts.append(text)
                    held += len(text)
            yield from counted(groups, texts, chunks)

        return in_batches(found(), COUNTED)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (lang, chunk), own in groupby(rows_of(batches), key=lambda r: r[:2]):
                m = Merge()
                for _, _, sources, payload in own:
                    m.add(sources, payload)
                yield from m.rows(lang, chunk)

        return in_batches(found(), VECTORS)

    told = docs.mapInArrow(count, ddl(COUNTED)).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk")
    return told.mapInArrow(merge, ddl(VECTORS))


def parts_of_scale(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole) for whole numbers with count <= whole, by long division, so nothing overflows below 9e15."""
    out, rest = np.divmod(count, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tile:
    """The submatrix of pairs of two blocks of sources over the chunks of a slab."""

    def __init__(self, square: bool):
        self.square, self.sources, self.sides, self.sizes, self.words, self.terms, self.seen = square, [], [], [], [], 0, 0

    def group(self, source: str, side: int, total: int, vocabulary: int, slab_terms: int) -> None:
        self.sources.append(source)
        self.sides.append(side)
        self.words.append(total + vocabulary)
        self.terms = slab_terms

    def start(self) -> None:
        self.number = {s: i for i, s in enumerate(self.sources)}
        self.whole = np.array(self.words, np.int64)[:, None]
        self.sum = np.zeros((len(self.sources),) * 2, np.int64)
        side = np.array(self.sides)
        self.wanted = (side[:, None] != side[None, :]) if not self.square else ~np.eye(len(side), dtype=bool)

    def pairs(self, p: np.ndarray) -> np.ndarray:
        """For all wanted pairs the sum over columns of their divergences."""
        out = np.zeros_like(self.sum)
        for a in range(len(p)):
            others = np.flatnonzero(self.wanted[a])
            out[a, others] = divergences(p[a], p[others]).sum(1)
        return out

    def chunk(self, own: list[tuple[str, bytes]]) -> None:
        got = [(self.number[s], np.cumsum(place.astype(np.int64)), times) for s, (place, times) in ((s, spread(v, np.uint32, np.int64)) for s, v in own)]
        seen = np.unique(np.concatenate([x[1] for x in got]))
        count = np.zeros((len(self.sources), len(seen)), np.int64)
        for i, place, times in got:
            count[i, np.searchsorted(seen, place)] = times
        self.sum += self.pairs(parts_of_scale(count + 1, self.whole))
        self.seen += len(seen)

    def rows(self) -> Iterator[tuple[str, str, int]]:
        if self.terms > self.seen:  # kept terms that none of the two blocks has
            self.sum += self.pairs(parts_of_scale(np.ones_like(self.whole), self.whole)) * (self.terms - self.seen)
        for a, b in zip(*np.nonzero(self.wanted), strict=True):
            yield self.sources[a], self.sources[b], int(self.sum[a, b])


TILE = "lang string, lower long, upper long, slab long, chunk long, source string, side long, total long, vocabulary long, slab_terms long, vector binary"
VALUES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, slab and chunk; those of chunk -1 tell the tile's sources."""

    def found() -> Iterator[tuple]:
        for (lang, lower, upper, _), own in groupby(rows_of(batches), key=lambda r: r[:4]):
            tile = Tile(lower == upper)
            for chunk, rows in groupby(own, key=lambda r: r[4]):
                if chunk < 0:
                    for r in rows:
                        tile.group(*r[5:10])
                    tile.start()
                else:
                    tile.chunk([(r[5], r[10]) for r in rows])
            for a, b, value in tile.rows():
                yield lang, a, b, value

    return in_batches(found(), VALUES, 4096)


def pair_values(held: DataFrame, info: DataFrame, slab_chunks: int = SLAB) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    tiles = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lower": F.least("block", "other"), "upper": F.greatest("block", "other"), "side": F.col("block")})
    slab = F.floor(F.col("chunk") / slab_chunks)
    sizes = held.groupBy("lang", slab.alias("slab")).agg(F.sum("lead").alias("slab_terms"))
    # a language that keeps no term has an empty slab, so that its pairs are told too
    bare = info.where("vocabulary = 0").select("lang", F.lit(0).cast("long").alias("slab"), F.lit(0).cast("long").alias("slab_terms")).distinct()
    names = [c.strip().split(" ")[0] for c in TILE.split(",")]
    nothing = F.lit(None).cast("binary").alias("vector")
    heads = tiles(info.join(sizes.unionByName(bare), "lang")).select(*[F.lit(-1).cast("long").alias(c) if c == "chunk" else nothing if c == "vector" else F.col(c).cast("string" if c in ("lang", "source") else "long").alias(c) for c in names])
    own = tiles(held.join(info.select("lang", "source", "block", "blocks"), ["lang", "source"]).withColumn("slab", slab))
    nil = lambda c: F.lit(0).cast("long").alias(c)
    rows = own.select(*[nil(c) if c in ("total", "vocabulary", "slab_terms") else F.col(c) if c in ("lang", "source", "vector") else F.col(c).cast("long").alias(c) for c in names])
    tile = ["lang", "lower", "upper", "slab"]
    dealt = heads.unionByName(rows).repartition(*tile).sortWithinPartitions(*tile, "chunk", "source")
    return dealt.mapInArrow(tiled, ddl(VALUES)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's terms that a source has more often than its language: those that can be among its first TOP."""

    def found() -> Iterator[tuple]:
        for lang, source, total, vocabulary, lang_total, vector, terms in rows_of(batches):
            times = spread(vector, np.uint32, np.int64)[1]
            all_times, sizes, raw = spread(terms, np.int64, np.uint32, np.uint8)
            p = parts_of_scale(times + 1, np.int64(total + vocabulary))
            q = parts_of_scale(all_times + 1, np.int64(lang_total + vocabulary))
            value = np.where(p > q, divergences(p, q), -1)
            least = np.partition(value, len(value) - TOP)[len(value) - TOP] if len(value) > TOP else -1
            at = np.flatnonzero((value >= least) & (p > q))
            ends, letters = np.cumsum(sizes), raw.tobytes()
            best = sorted((-int(value[i]), letters[ends[i] - sizes[i] : ends[i] - 1]) for i in at)[:TOP]
            for v, term in best:
                yield lang, source, term.decode(), -v

    return in_batches(found(), VALUES, 4096)


def audit(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK, slab_chunks: int = SLAB) -> DataFrame:
    """lang, source, part, item, value, rank; see the module and `divergences`.

    Part `pair`: item is each other source of the language, value the sum over the language's kept terms of
    floor((p - q)^2 / q), with p the source's and q the item's share in SCALE parts, each count raised by one.  Part
    `term`: item is a kept term of larger share in the source than in the language, value its divergence, ranks up to
    TOP.  Ranks begin at 1, values descending, items ascending by their UTF-8 bytes.

    Null text, lang and source count as empty.  Documents are rows: a repeated row counts again.  A source without
    terms, and a language without kept terms, has its pairs too (value 0 where nothing is kept); a language of one
    source has none.  Very long texts are counted whole, by themselves.  An empty table gives no rows; other columns
    are not read.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = docs.select(plain("lang"), plain("source"), plain("text"))
    held = cut(vectors(own, chunk_bytes))
    totals = held.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    langs = held.groupBy("lang").agg(F.sum("lead").alias("vocabulary"), F.sum("total").alias("lang_total"))
    groups = own.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).join(langs, "lang", "left")
    info = groups.join(blocks, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["vocabulary", "lang_total", "total"])
    info = cut(info.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))
    pairs = pair_values(held, info, slab_chunks)
    chosen = held.drop("total").join(info, ["lang", "source"]).select("lang", "source", "total", "vocabulary", "lang_total", "vector", "terms")
    terms = chosen.mapInArrow(own_terms, ddl(VALUES))
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).withColumn("part", F.lit(part))
    columns: list[Column | str] = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs, "pair").select(*columns).unionByName(ranked(terms, "term").where(F.col("rank") <= TOP).select(*columns))
