"""Shield by origin, batched retrieval, dialogue state and terms on rows written by hand, against plain versions."""

import itertools
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens import plans
from offerlens.plans import questions as registered  # noqa: F401
from offerlens.functions import text
from offerlens.operators import dialogue, questions, retrieval, terms
from offerlens.streaming import dialogue as streamed


def test_a_taken_name_raises():
    def answer_shield(spark, sf_dir):
        return None

    with pytest.raises(ValueError):
        plans.query()(answer_shield)


def test_shield(spark):
    rows = [
        (1, "structural", "Oran %1,5", None, None, [1.5], None, None, []), (2, "structural", "Oran %15", None, None, [1.5], None, None, ["15"]), (3, "structural", "125 TL", None, None, [1.25], None, None, ["125"]),
        (4, "structural", "1.250 TL, 1.250,00 TL ve 1250 TL", None, None, [1250.0], None, None, []), (5, "structural", "Bitiş 31.12.2026, yani 2026", None, None, None, None, [date(2026, 12, 31)], []),
        (6, "structural", "Oran 1,23", None, None, [1.234], None, None, []), (7, "structural", "Oran 1,3", None, None, [1.25], None, None, ["1,3"]), (8, "quote", "«50 bin TL» ve 36 ay", "50 bin TL", "En çok 50 bin TL verilir", [36.0], None, None, []),
        (9, "quote", "60 bin TL", "60 bin TL", "En çok 50 bin TL verilir", None, None, None, []), (10, "quote", "50 bin TL", "50 bin TL", None, None, None, None, []), (11, "system", "Skor 0,625", None, None, None, [0.625], None, []),
        (12, "system", "Skor 0,626", None, None, [0.626], [0.625], None, ["0,626"]), (13, "plain", "Yaklaşık 50 TL", None, None, [50.0], None, None, ["50"]), (14, "plain", "Bilgi yok, 3. madde", None, None, None, None, None, []), (15, "legacy", "99 TL", None, None, None, None, None, []),
        (16, "structural", None, None, None, None, None, None, []), (17, "plain", "", None, None, None, None, None, []),
    ]
    parts = spark.createDataFrame(rows, "id int, origin string, content string, quote string, source string, allowed array<double>, computed array<double>, days array<date>, want array<string>")
    got = {r.id: r for r in questions.shielded(parts).collect()}
    assert {i: r.unbacked for i, r in got.items()} == {r[0]: r[-1] for r in rows}
    assert {i for i, r in got.items() if r.blocked} == {2, 3, 7, 9, 10, 12, 13} and {i for i, r in got.items() if not r.checked} == {15}


def plain_nearest(vectors, queries, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    out = {}
    for q, own, e in queries:
        best = {}
        for v, record, x in vectors:
            if x is not None and record is not None and record != own:
                key = (-round(float(unit(e) @ unit(x)), 9), v)
                best[record] = min(best.get(record, (2, 0)), key)
        out |= {(q, rank): (v, record, -s) for rank, (s, v, record) in enumerate(sorted((*b, r) for r, b in best.items())[:k], 1)}
    return out


@pytest.mark.parametrize("tiles", [(1 << 16, 1 << 13), (40, 7), (1, 1)])
def test_nearest_records(spark, tiles):
    rng = random.Random(3)
    some = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(30)]
    vectors = [(i, None if i == 7 else i // 3, None if i == 8 else rng.choice(some)) for i in range(120 if tiles != (1, 1) else 12)] + [(900, 900, [0.0] * 4)]
    queries = [(i * 10, rng.choice([None, i]), rng.choice(some)) for i in range(15 if tiles != (1, 1) else 3)]
    v = spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, record_id long, embedding array<float>, score string").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in queries] + [(999, 1, None, "x")], "query_id long, record_id long, embedding array<float>, vec_id string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.record_id, r.score) for r in retrieval.nearest_records(v, q, 4, *tiles).collect()}
    want = plain_nearest(vectors, queries, 4)
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-8 for k in want)
    assert retrieval.nearest_records(v.limit(0), q).count() == 0 and retrieval.nearest_records(v, q.limit(0)).count() == 0


TURNS = "conv_id long, turn long, kind string, bank string, product string, topic string, criterion string, direction string, amount double, months int, extra string"


def some_turns():
    rng = random.Random(11)
    pick = lambda x, p: x if rng.random() < p else None
    return [
        (c, t, rng.choice(["plain"] * 6 + ["corpus", "neutral", None]), pick(rng.choice("ab"), 0.2), pick("home", 0.15), pick("fuel", 0.2), pick(rng.choice(["rate", "term"]), 0.25), pick("least", 0.25), pick(float(rng.randint(1, 9) * 1000), 0.3), pick(rng.randint(1, 60), 0.3), "x")
        for c in range(60)
        for t in range(0, rng.randint(1, 24), 2)
    ]


def folded(rows, expiry):
    out = []
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        state = {}
        for r in own:
            kind = r[2] or "plain"
            state, slots, carried = dialogue.step(state, kind, dict(zip(dialogue.SLOTS, r[3:10])), expiry)
            out.append((conv, r[1], kind, *[slots.get(s) for s in dialogue.SLOTS], " · ".join(f"{s}: {int(slots[s]) if s == 'amount' else slots[s]}" for s in carried)))
    return out


@pytest.mark.parametrize("expiry", [1, 3])
def test_dialogue_by_windows_is_the_fold(spark, expiry):
    rows = some_turns()
    got = [tuple(r) for r in dialogue.resolved(spark.createDataFrame(rows, TURNS).repartition(4), expiry).collect()]
    assert sorted(got, key=lambda r: r[:2]) == folded(rows, expiry)
    assert dialogue.resolved(spark.createDataFrame([], TURNS)).count() == 0


def test_dialogue_stream_over_batches(spark, tmp_path):
    """Turns arrive in three files, read one a batch; the last repeats turns, which are passed over."""
    rows = sorted(some_turns(), key=lambda r: r[1])
    third = len(rows) // 3
    for i, part in enumerate((rows[:third], rows[third : 2 * third], rows[third + 5 :])):
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(TURNS).parquet(str(tmp_path / "in"))
        store = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(store)
        spark.conf.set(store, streamed.STORE)
        try:
            streamed.stream_resolved(source, 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(store, before)
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: r[:2])
    assert got == folded(rows, 2)


def test_what_turns_state(spark):
    said = ["Albaraka en düşük kâr payı oranı?", "Hangi bankalar konut sunuyor?", "Murabaha nedir?", "Akaryakıt kampanyası 50.000 TL, 12 ay", None, ""]
    turns = spark.createDataFrame([(1, i, q) for i, q in enumerate(said)], "conv_id long, turn long, question string")
    got = {r.turn: tuple(r)[2:] for r in dialogue.stated(turns, spark.createDataFrame([("Albaraka Türk",), ("Kuveyt Türk",)], "bank string")).collect()}
    assert got[0] == ("plain", "Albaraka Türk", None, None, "rate", "least", None, None) and got[1][:3] == ("corpus", None, "home") and got[2][0] == "neutral"
    assert got[3] == ("plain", None, None, "akaryakit", None, None, 50000.0, 12) and got[4] == got[5] == ("plain",) + (None,) * 7


def test_terms(spark):
    held = ["kar payi", "kar payi dagitim orani", "vade farksiz", "eft", "murabaha", "ek", "a b c", "kar"]
    texts = ["Kâr payı dağıtım oranının tanımı", "KAR PAYININ", "vade", "EFT'ler", "eft ücreti", "murabahanın şartı", "ekler", "a b cd", "ab c", None, "", "sakar payı", "x " * 50_000 + "murabaha", "kar"]
    own = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "text_id long, text string, key string")
    words = spark.createDataFrame([(k, "n") for k in [*held, *held, None, ""]], "key string, own string")
    got = dict(terms.longest(words, own).collect())
    assert got == {0: "kar payi dagitim orani", 1: "kar payi", 4: "eft", 5: "murabaha", 7: "a b c", 12: "murabaha", 13: "kar"}
    asked = ["vade nedir?", "Vade ile kredi arasındaki fark ne?", "x ve vade ne demek", "kar payi dagitim nedir", "yok nedir", None]
    asking = spark.createDataFrame(list(enumerate(asked)), "text_id long, text string")
    got = {r.text_id: (r.key, r.found) for r in terms.defined(words, asking).collect()}
    assert got == {0: ("vade farksiz", "begun"), 1: ("vade farksiz", "begun"), 2: ("vade farksiz", "begun"), 3: ("kar payi", "whole")}
    assert terms.longest(words.limit(0), own).count() == 0 and terms.longest(words, own.limit(0)).count() == 0


def test_counterparts(spark):
    said = {"`kar_payi`": ("identity", "kar_payi"), "Kavramsal — `kar_payi` faiz değildir": ("confusable", "kar_payi"), "`odul`; `kar_payi` vetosu": ("identity", "odul"), "tek alan değil, **hesaplanır**": ("computed", None), "`URUN`": ("concept", None), "`masrafsiz=true`": ("identity", "masrafsiz"), None: ("concept", None)}
    rows = terms.counterparts(spark.createDataFrame([(k,) for k in said], "counterpart string")).collect()
    assert {r.counterpart: (r.kind, r.field) for r in rows} == said


def test_keys_that_had_no_query(spark):
    def one(value, *fs):
        return tuple(spark.createDataFrame([(value,)], "x string").select(*[f(F.col("x")).alias(f"f{i}") for i, f in enumerate(fs)]).first())

    assert one("İIŞ ğ", text.lower_tr, text.upper_tr, text.unhat) == ("iış ğ", "İIŞ Ğ", "İIŞ ğ") and one("Kâr'ın", text.split_apostrophes, text.squashed_key) == ("Kâr ın", "karin")
