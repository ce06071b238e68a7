"""Topic words against a plain greedy choice, verb forms by hand, answers off their topic."""

from collections import Counter, defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import topics


def related(a, b):
    short = min(len(a), len(b))
    return a[:5] == b[:5] if short >= 5 else short == 4 and a[:4] == b[:4]


def plain_topics(rows, resolved, k, ceiling):
    """The choice word by word, with all pairs of words."""
    most = max(1, int(len(rows) * ceiling))
    names = [(g, {w for w in (n or "").split() if len(w) >= 4 and not w.isdigit()}) for g, n in rows]
    verb = lambda w: any(m in w[2:] for m in topics.VERB_MARKS) or any(w.endswith(e) and len(w) - 2 <= 3 for e in ("an", "en"))
    counts, df = defaultdict(Counter), {}
    for g, words in names:
        for w in words:
            if not verb(w) and not any(related(w, r) for r in resolved):
                df[w] = sum(any(related(w, x) for x in own) for _, own in names)
                counts[g][w] += df[w] <= most
    out = set()
    for g, c in counts.items():
        taken = []
        for w, n in sorted(c.items(), key=lambda p: (-p[1], p[0])):
            if n and len(taken) < k and not any(related(w, t) for t in taken):
                taken.append(w)
                out.add((g, len(taken), w, n, df[w]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_topics_equal_the_plain_choice(spark, seed):
    r = Random(seed)
    stems = ["abcd", "abce", "xyzt", "mark", "yaki"]
    words = [s + e for s in stems for e in ("", "a", "b", "aa", "ab", "bq", "iyor", "digi")] + ["olan", "veren", "1234", "abc"]
    rows = [(r.choice(["p", "q", None]), r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 6)))])) for _ in range(60)]
    resolved = ["yakia"]
    frame = spark.createDataFrame([(g, n, "x") for g, n in rows], "group string, name string, n string")
    got = topics.topics(frame, spark.createDataFrame([("yakia",), (None,)], "word string"), 3, 0.3).collect()
    want = plain_topics(rows, resolved, 3, 0.3)
    assert want and {tuple(x) for x in got} == want and len(got) == len(want)


def test_no_records_and_long_names(spark):
    none = spark.createDataFrame([], "group string, name string")
    words = spark.createDataFrame([], "word string")
    assert topics.topics(none, words).count() == 0
    long = spark.createDataFrame([("g", " ".join(f"w{i:05d}" for i in range(100_000)))], "group string, name string")
    assert [r["word"] for r in topics.topics(long, words).orderBy("rank").collect()] == ["w00000", "w00010", "w00020"]


def test_verb_forms(spark):
    words = "olan veren restoran mobilden yapiliyorsa geldiginde yorgun sundugu market en verdigi".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", topics.inflected(F.col("w")), topics.qualifier(F.col("w")), topics.participle(F.col("w"))).collect()
    assert {r[0] for r in rows if r[1]} == {"yapiliyorsa", "geldiginde", "sundugu", "verdigi"}
    assert {r[0] for r in rows if r[2]} == {"olan", "veren", "en"}
    assert {r[0] for r in rows if r[3]} == {"olan", "veren", "restoran", "mobilden", "sundugu", "verdigi"}


def test_answers_off_their_topic(spark):
    records = spark.createDataFrame([(1, "akaryakıt kampanyası"), (2, "market"), (2, "akaryakıtta iade"), (3, None), (4, "restoranlarda")], "record int, name string")
    answers = spark.createDataFrame(
        [("a", "akaryakit", 1), ("b", "akaryakit", 2), ("c", "akaryakit", 1), ("c", "akaryakit", 4), ("d", "akaryakit", 9), ("e", "akaryakit", 3), ("f", "akaryakit", None), ("g", "akaryakit", 9), ("g", "akaryakit", 4)],
        "answer string, topic string, record int",
    )
    assert {tuple(r) for r in topics.on_topic(answers, records).collect()} == {("a", True), ("b", True), ("c", False), ("d", True), ("e", False), ("f", True), ("g", False)}
