"""Operator 11 against a plain version with Python's whole numbers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from offerlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(docs):
    """docs: (text, lang, source); the rows as a set of (lang, source, part, item, value, rank)."""
    groups, spread = {}, {}
    for text, lang, source in docs:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        spread.setdefault(lang or "", Counter()).update(set(terms))
    out = set()
    for lang, of in groups.items():
        kept = sorted(t for t, n in spread[lang].items() if n >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: B023,E731
        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        for s in of:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in of if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, 200)):
                ordered = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "text string, lang string, source string, chunk long, vector string, block string").repartition(4)


def some(rng, n_sources):
    words = ["".join(rng.choices("aBcdÉß", k=rng.randint(1, 4))) for _ in range(700)]
    out = []
    for i in range(400):
        own = words[: 60 if i % 3 else 700]
        out.append((rng.choice([" ", "\n", "1-2", "\x00_"]).join(rng.choices(own, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "en", None, "de"]), f"s{rng.randrange(n_sources)}" if i % 3 else "hot"))
    return out


@pytest.mark.parametrize(("n_sources", "chunk_bytes", "block", "slab_chunks"), [(7, 1 << 20, 16, 16), (9, 500, 3, 2), (30, 2000, 4, 1)])
def test_against_plain(spark, n_sources, chunk_bytes, block, slab_chunks):
    rng = random.Random(n_sources)
    docs = some(rng, n_sources) + [(None, None, None), ("", "empty", "a"), (None, "empty", "b"), ("alone", "one", "a"), ("x " * 100_000 + "Äé", "en", "long"), ("I İ ı K", "en", "hot")] + [("same words here", "en", "hot")] * 5
    rows = divergence.audit(frame(spark, docs), chunk_bytes, block, slab_chunks).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows} == plain(docs)
    assert len(rows) == len(plain(docs))


def test_empty(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_long_division():
    rng = random.Random(1)
    whole = [rng.randrange(1, 9 * 10**15) for _ in range(200)]
    count = [rng.randrange(0, w + 1) for w in whole]
    assert divergence.parts_of_scale(np.array(count), np.array(whole)).tolist() == [1 + 10**9 * c // w for c, w in zip(count, whole)]
