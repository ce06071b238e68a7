"""Operator 13 against a plain version that applies each order's filters one after another."""

import re
from itertools import permutations

import pytest

from offerlens.llm import interactions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """docs: (doc_id, text, source); rows as the operator gives them."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((s or "", {f for f, x in own.items() if x}, i))
    out = {}
    for part in {s for s, _, _ in fails}:
        rows, removed = [(f, i) for s, f, i in fails if s == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                removed[f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone))
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step] += (removed[f],)
    return out


def frames(spark, docs, labels):
    extra = [(*d, "x", 1, True) for d in docs]  # columns whose names clash with the operator's own
    return spark.createDataFrame(extra, "doc_id long, text string, source string, part string, pattern int, known boolean").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_plain(spark):
    many = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t", many, many, "AB " * 60, "ab " * 60, many + " #", "É" * 10 + " Z", many.upper(), "a b " * 30, "x" * 300_000, "AbC|" * 30]
    docs = [(i, t, ["s1", None, "", "s2"][i % 4]) for i, t in enumerate(texts)]
    docs += [(3, many, "s2"), (3, many, "s2"), (40, many, "s1"), (41, "", "s2"), (41, "", "s2"), (None, many, "s1"), (None, None, None), (50, "ab " * 60, "s1"), (51, "ab " * 60, "s1")]
    labels = [(3, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (40, 1, 1), (51, 0, 1), (41, 1, 0), (99, 1, 1), (0, None, 1)]
    got = interactions.audit(*frames(spark, docs, labels)).collect()
    want = plain(docs, labels)
    assert len(got) == len(want) == 3 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_empty_and_single(spark, labels):
    assert interactions.audit(*frames(spark, [], labels)).count() == 0
    docs = [(1, "one", "s")]
    got = interactions.audit(*frames(spark, docs, labels)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(docs, labels)
