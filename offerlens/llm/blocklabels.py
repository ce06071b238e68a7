"""Main text of pages by a recurrent labeller of their blocks (operator 12).

A page is a sequence of leaf blocks.  Each block is a vector: hashed names and marks of the elements around it, hashed
words, and a few figures (length, links, punctuation, place).  A bidirectional LSTM in numpy reads the whole sequence,
so every block is classified in the context of all others of its page; the blocks it takes for the article are joined.

The labeller is trained at each run on a bounded sample of pages.  Where a sampled page marks its article, its blocks
teach as they are; the same texts are also dealt into layouts drawn by rule, with articles, menus, notices, adverts,
forms, sidebars, comments and footers under many names, whose labels are known, so that no single template is learned.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.blockpages import Leaf, leaves
from offerlens.llm.digest import mix, prefix, span

#: Pages learned from (those of least hash) and the longest that is, in bytes; layouts drawn; blocks of a page learned from.
TRAIN_PAGES, TRAIN_BYTES, LAYOUTS, TRAIN_BLOCKS = 200, 100_000, 1800, 60
PATH_DIMS, WORD_DIMS, FIGURES, HIDDEN = 320, 48, 14, 24
DIMS = PATH_DIMS + WORD_DIMS + FIGURES
EPOCHS, BATCH, RATE = 8, 48, 0.008
#: Blocks that the labeller reads side by side.
READ_BLOCKS = 8192


def hashed(name: str) -> list[int]:
    """Two places of a name, so that names which share one differ in the other."""
    h = crc32(name.encode()) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return [(h >> 20) % PATH_DIMS, (h >> 42) % PATH_DIMS]


@lru_cache(maxsize=20_000)
def path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Which names and marks stand around a block, those of the nearest two elements apart; marks also by their first four letters."""
    out = np.zeros(PATH_DIMS, np.float32)
    for depth, (tag, *own) in enumerate(reversed(path)):
        for mark in [f"<{tag}", *[m[:4] + "~" for m in own], *own]:
            out[hashed(mark)] = 1
        if depth < 2:
            out[hashed(f"{depth}<{tag}")] = 1
    return out


def word_vectors(texts: list[str]) -> np.ndarray:
    """Hashed counts of each text's words in lower case, as unit vectors of their logarithms."""
    raw = np.frombuffer(" ".join(texts).lower().encode() + b" ", np.uint8)
    ends = np.flatnonzero(raw == 32)  # white space inside a block is one blank
    starts = np.concatenate([[0], ends[:-1] + 1])
    pre = prefix(raw.astype(np.uint64))
    word = (mix(span(pre, starts, ends)) % np.uint64(WORD_DIMS)).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [t.count(" ") + 1 for t in texts])
    counts = np.log1p(np.bincount(of * WORD_DIMS + word, minlength=len(texts) * WORD_DIMS)).astype(np.float32).reshape(-1, WORD_DIMS)
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-6)


def figures(page: list[Leaf]) -> np.ndarray:
    out = np.zeros((len(page), FIGURES), np.float32)
    for i, (text, path, linked) in enumerate(page):
        n, words = len(text), text.count(" ") + 1
        out[i] = (
            np.log1p(n) / 6, np.log1p(words) / 5, linked / n, text[-1] in ".!?…:;\"”»", text.count(",") / words, (text.count(".") + text.count("?")) / words, text[0].isupper(),
            n / words / 10, i / len(page), (len(page) - i) / len(page), path[-1:] == page[i - 1].path[-1:] if i else 0, path == page[i - 1].path if i else 0, len(path) / 10, 1,
        )
    return out


def vectors(page: list[Leaf]) -> np.ndarray:
    """One row of DIMS for each block."""
    if not page:
        return np.zeros((0, DIMS), np.float32)
    return np.concatenate([np.stack([path_vector(x.path) for x in page]), word_vectors([x.text for x in page]), figures(page)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One direction of the LSTM over padded sequences [steps, pages, dims]; pages are left-aligned."""

    def __init__(self, rng: np.random.Generator):
        self.w = rng.normal(0, 0.1, (DIMS, 4 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1  # at first, cells remember

    def forward(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        steps, pages, _ = x.shape
        pre = x.reshape(-1, DIMS) @ self.w + self.b
        pre = pre.reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            gates = pre[t] + h @ self.u
            i, f, o = np.split(sigmoid(gates[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            wave = np.tanh(c)
            h = o * wave
            out[t] = h
            if keep:
                kept.append((i, f, o, g, before, wave, h_before))
        return out, kept

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        steps, pages, _ = x.shape
        d_pre = np.empty((steps, pages, 4 * HIDDEN), np.float32)
        d_u, d_h, d_c = np.zeros_like(self.u), np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, wave, h_before = kept[t]
            d = d_out[t] + d_h
            d_c = d_c + d * o * (1 - wave * wave)
            d_gates = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d * wave * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
            d_pre[t] = d_gates
            d_u += h_before.T @ d_gates
            d_h = d_gates @ self.u.T
            d_c = d_c * f
        flat = d_pre.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, DIMS).T @ flat, d_u, flat.sum(0)]


class Labeller:
    """A bidirectional LSTM over a page's blocks, and for each block the chance that it is the article's."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.out = rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.out, self.bias]

    @staticmethod
    def laid(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded sequences, the same turned round, and where each block of the turned ones came from."""
        steps = max(len(p) for p in pages)
        x, turned = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        place = np.tile(np.arange(steps)[:, None], (1, len(pages)))
        for k, p in enumerate(pages):
            x[: len(p), k], turned[: len(p), k] = p, p[::-1]
            place[: len(p), k] = np.arange(len(p))[::-1]
        return x, turned, place

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page its blocks' chances; pages are read side by side, whole."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            many = max(1, READ_BLOCKS // len(pages[order[0]]))
            own = order[:many]
            while len(own) > 1 and len(own) * len(pages[own[-1]]) > 2 * READ_BLOCKS:
                own = own[: len(own) // 2]
            order = order[len(own) :]
            x, turned, place = self.laid([pages[i] for i in own])
            h = np.concatenate([self.ahead.forward(x, False)[0], np.take_along_axis(self.back.forward(turned, False)[0], place[:, :, None], 0)], axis=2)
            p = sigmoid(h @ self.out + self.bias)
            for k, i in enumerate(own):
                out[i] = p[: len(pages[i]), k]
        return out

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        x, turned, place = self.laid(pages)
        want, own = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
        for k, y in enumerate(labels):
            want[: len(y), k], own[: len(y), k] = y, 1
        ahead, kept_ahead = self.ahead.forward(x, True)
        back, kept_back = self.back.forward(turned, True)
        h = np.concatenate([ahead, np.take_along_axis(back, place[:, :, None], 0)], axis=2)
        d = (sigmoid(h @ self.out + self.bias) - want) * own / own.sum()
        d_h = d[:, :, None] * self.out
        d_turned = np.take_along_axis(d_h[:, :, HIDDEN:], place[:, :, None], 0)  # turning round twice is the identity
        return [*self.ahead.backward(x, kept_ahead, d_h[:, :, :HIDDEN]), *self.back.backward(turned, kept_back, d_turned), (h * d[:, :, None]).sum((0, 1)), d.sum(keepdims=True).ravel()]

    def learn(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adam on pages of like length; at each epoch in another order."""
        rng, weights = np.random.default_rng(seed), self.weights()
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(epochs):
            by_length = sorted(range(len(pages)), key=lambda i: len(pages[i]) + rng.uniform(0, 6))
            batches = [by_length[i : i + BATCH] for i in range(0, len(by_length), BATCH)]
            for b in rng.permutation(len(batches)):
                step += 1
                rate = RATE * (1 - epoch / epochs * 0.8)
                for w, g, m, v in zip(weights, self.gradients([pages[i] for i in batches[b]], [labels[i] for i in batches[b]]), first, second, strict=True):
                    g = np.clip(g, -1, 1)
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


# How pages name their parts, an element with its marks.  Of each kind a layout draws one.
ARTICLE = ["article", "main", "main article", "div.content", "div.main-content", "div.post div.entry-content", "section.article-body", "div.article", "div.story", "div#content", "div.text", "div.page div.body", "td", "div", "div.x", "div.post-body", "section", "div#main", "article div.content", "div.blog-post"]
PARTS = {
    "menu": ["nav ul li", "nav", "ul.menu li", "div.navbar ul li", "div#nav", "header nav ul li", "div.menu", "div.breadcrumb", "ol.breadcrumbs li", "ul.pagination li", "div.tabs ul li", "div.x ul li"],
    "header": ["header", "div.header", "div#header", "header.site-header", "div.masthead", "div.top-bar", "div.banner", "header div.logo"],
    "footer": ["footer", "footer p", "div.footer", "div#footer p", "footer.site-footer ul li", "div.copyright", "div.legal", "div.bottom", "footer div.imprint"],
    "side": ["aside", "aside p", "div.sidebar", "aside.sidebar p", "div#sidebar p", "div.widget", "div.side-column p", "aside ul li", "div.related ul li", "section.related-posts p", "div.recommended", "div.teaser p", "div.popular ul li"],
    "notice": ["div.cookie-notice", "div.cookie-banner p", "div#cookies", "div.consent p", "div.notice", "div.alert", "p.notice", "div.popup p", "div.gdpr", "div.message", "div.warning", "div.paywall", "div.disclaimer", "div.overlay.modal p", "div[role=alert]", "div.hidden", "section.privacy-notice p"],
    "advert": ["div.ad", "div.ads", "div.advert", "aside.advertisement", "div.sponsored p", "div.promo", "div.promotion p", "ins.adsbygoogle", "div.banner-ad", "section.ad p", "div.sponsor"],
    "form": ["form", "form label", "form.newsletter p", "div.subscribe form p", "form.search button", "form fieldset legend", "form select option", "div.login form label", "form.contact textarea", "div.newsletter", "div.signup p"],
    "comments": ["section.comments", "section#comments p", "div.comments p", "div.comment p", "ol.comment-list li p", "ul.comments li", "div#comments div.comment", "div.reader-comments p", "div.discussion p", "section.responses p", "div.replies p", "article.comment p", "div#disqus-thread p", "div.user-comments div.comment-body"],
    "share": ["div.share", "ul.social li", "div.share-buttons", "div.tags", "div.byline-share", "div.social-links ul li"],
}
BLOCKS = ["p", "p", "p", "p", "p", "p", "", "ul li", "ol li", "blockquote", "blockquote p", "pre", "table tr td", "h2", "h3", "div", "figure figcaption", "section p"]
CUES = "Home Menu About Contact Login Subscribe Share Reply Comments Advertisement Sponsored Cookie Accept Privacy Terms Copyright © Search Newsletter Related More Next Previous Tags Sign up".split(" ")


def elements(described: str, rng: random.Random) -> tuple[tuple[str, ...], ...]:
    """`div.a-b p` as path elements; the mark x is some name without meaning."""
    out = []
    for one in described.split():
        tag, *own = one.replace("#", ".").replace("[role=", ".").rstrip("]").split(".")
        out.append((tag, *[w for m in own for w in (m.split("-") if m != "x" else ["".join(rng.choices("bcdfghklmnprstvw", k=rng.randint(2, 6)))])]))
    return tuple(out)


def layout(texts: list[str], rng: random.Random) -> tuple[list[Leaf], list[int]]:
    """A page drawn by rule from article texts, and which of its blocks are its article's."""
    page: list[Leaf] = []
    labels: list[int] = []
    root = elements(rng.choice(["html body", "html body", "body", "html body div.wrapper", "html body div#page div.container", "html body div.x", "html body div", "html body table tr"]), rng)

    def some(words: int) -> str:
        text = rng.choice(texts).split(" ")
        at = rng.randrange(max(1, len(text) - words))
        own = text[at : at + words]
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = rng.choice(CUES)
        return " ".join(own)

    def add(path: tuple, text: str, label: int, linked: float = 0.0) -> None:
        if text.strip():
            page.append(Leaf(text, path, int(len(text) * linked)))
            labels.append(label)

    def part(kind: str, at: tuple) -> None:
        own = at + elements(rng.choice(PARTS[kind]), rng)
        if kind in ("menu", "share"):
            for _ in range(rng.randint(2, 9)):
                add(own, some(rng.randint(1, 3)), 0, rng.choice([1.0, 1.0, 1.0, 0.0]))
        elif kind == "comments":
            if rng.random() < 0.5:
                add(own[:-1] + (("h3",),) if len(own) > len(at) + 1 else own + (("h3",),), some(rng.randint(1, 4)), 0)
            for _ in range(rng.randint(1, 6)):
                if rng.random() < 0.3:
                    add(own, some(rng.randint(1, 4)), 0, rng.choice([0.0, 0.5]))
                add(own, rng.choice(texts) if rng.random() < 0.5 else some(rng.randint(3, 40)), 0)
        elif kind in ("side", "footer", "form"):
            for _ in range(rng.randint(1, 5)):
                add(own, rng.choice(texts) if rng.random() < 0.15 else some(rng.randint(1, 14)), 0, rng.choice([0.0, 0.0, 0.5, 1.0]))
        else:
            for _ in range(rng.randint(1, 2)):
                add(own, rng.choice(texts) if rng.random() < 0.25 else some(rng.randint(2, 20)), 0, rng.choice([0.0, 0.0, 0.0, 0.4]))

    if rng.random() < 0.8:
        add((("html",), ("head",), ("title",)), some(rng.randint(2, 10)), 0)
    before = [k for k, chance in (("notice", 0.35), ("header", 0.5), ("menu", 0.8), ("advert", 0.4), ("side", 0.25), ("form", 0.15)) if rng.random() < chance]
    rng.shuffle(before)
    for kind in before:
        part(kind, root)
    own = root + elements(rng.choice(ARTICLE), rng)
    if rng.random() < 0.85:
        add(own + rng.choice([(("h1",),), (("h1",),), (("header",), ("h1",)), (("h2",),)]), some(rng.randint(2, 12)), 1)
    blocks = rng.choice([["p"], ["p"], ["p", "p", "h2"], BLOCKS, [rng.choice(BLOCKS)], [""], ["div"]])
    for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 8, 12, 20])):
        text = rng.choice(texts) if rng.random() < 0.8 else some(rng.randint(1, 12))
        kind = rng.choice(blocks)
        add(own + elements(kind, rng), some(rng.randint(1, 8)) if kind in ("h2", "h3") else text, 1, rng.choice([0.0, 0.0, 0.0, 0.0, 0.1]))
        if rng.random() < 0.12:
            part(rng.choice(["advert", "advert", "share", "form", "side", "notice"]), own)
    if rng.random() < 0.3:
        part(rng.choice(["share", "form", "comments", "comments", "side", "advert"]), own)
    after = [k for k, chance in (("comments", 0.45), ("side", 0.4), ("advert", 0.2), ("form", 0.25), ("share", 0.2), ("menu", 0.15), ("notice", 0.1)) if rng.random() < chance]
    rng.shuffle(after)
    for kind in after:
        part(kind, root)
    if rng.random() < 0.85:
        part("footer", root)
    return page, labels


def taught(page: list[Leaf]) -> list[int] | None:
    """Which blocks a page marks as its article's, by article or main elements without parts of other names; null if by none."""
    named = lambda kinds: {m for k in kinds for e in elements(k.replace(".x", ""), random.Random(0)) for m in e[1:]}
    outside = {"nav", "aside", "footer", "form", "title"} | named(k for own in PARTS.values() for k in own) - named(ARTICLE)
    marked = [any(e[0] in ("article", "main") for e in x.path) and not any(m in outside for e in x.path for m in e) for x in page]
    return [int(m) for m in marked] if any(marked) else None


def train(pages: list[str]) -> Labeller:
    """A labeller from the texts of some pages."""
    rng = random.Random(7)
    own = [p for p in (leaves(x) for x in pages) if 0 < len(p) <= TRAIN_BLOCKS]
    lessons = [(p, y) for p in own for y in [taught(p)] if y]
    texts = [x.text for p, y in lessons for x, one in zip(p, y, strict=True) if one] or [x.text for p in own for x in p]
    texts = texts or [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) + "." for n in range(3, 60)]
    lessons += [layout(texts, rng) for _ in range(LAYOUTS)]
    lessons = [(p[:TRAIN_BLOCKS], y[:TRAIN_BLOCKS]) for p, y in lessons if p]
    out = Labeller()
    out.learn([vectors(p) for p, _ in lessons], [np.array(y, np.float32) for _, y in lessons])
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks and n_kept: each page's main text and how many of its blocks that is.

    Blocks stand in page order, parted by an empty line; each is its text with references decoded and white space,
    no-break spaces too, as one blank.  Null and empty pages, and pages without an article's block, have the empty
    text.  Repeated rows are judged alike, whole pages whatever their length (a page's vectors are held in one task).
    An empty table gives an empty result; extra columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    fit = rows.where(F.octet_length("html").between(1, TRAIN_BYTES)).select(F.xxhash64("html").alias("h"), "html")
    least = [r["h"] for r in fit.select("h").distinct().orderBy("h").limit(train_pages).collect()]  # copies count once; tasks send hashes only
    sample = fit.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    held = rows.sparkSession.sparkContext.broadcast(train([r["html"] for r in sample]))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [leaves(x) if x else [] for x in part.column(2).to_pylist()]
                kept = [[x.text for x, c in zip(p, chance, strict=True) if c >= 0.5] for p, chance in zip(parsed, held.value.chances([vectors(p) for p in parsed]), strict=True)]
                texts = ["\n\n".join(k) for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in parsed], pa.int64()), pa.array([len(k) for k in kept], pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
