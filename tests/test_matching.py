"""Near spellings against all pairs, foreign names, cut-off answers, cookie layers, and the state of an index of vectors."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from offerlens.operators import matching, texts, vectors


@pytest.mark.parametrize("cutoff", [0.88, 0.75, 0.6])
def test_near_spellings_are_those_of_all_pairs(spark, cutoff):
    r, letters = random.Random(5), "abcde"
    held = ["".join(r.choices(letters, k=r.randint(3, 14))) for _ in range(120)]
    asked = [w[: (i := r.randrange(len(w)))] + r.choice(["", "x", w[i : i + 1] * 2]) + w[i + r.randint(0, 1) :] for w in held] + ["", None, "abc", held[0], held[0]]
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {x.word: (x.near, round(x.ratio, 9)) for x in matching.near_spellings(frame(asked), frame([*held, None]), cutoff).collect()}
    want = {}
    for w in {w for w in asked if w and len(w) >= 5}:
        best = min(((-SequenceMatcher(None, w, v).ratio(), v) for v in set(held) if len(v) >= 5), default=(0, ""))
        if -best[0] >= cutoff:
            want[w] = (best[1], round(-best[0], 9))
    assert got == want and len(want) > 30
    assert matching.near_spellings(frame([]), frame(held)).count() == 0
    with pytest.raises(ValueError):
        matching.near_spellings(frame(asked), frame(held), 0.4)


def test_banks_are_recognised_in_steps(spark):
    banks = spark.createDataFrame([("Albaraka Türk",), ("Kuveyt Türk",), ("Türkiye Finans",), ("Ziraat Katılım",), ("Vakıf Katılım",), (None,), ("",)], "bank string")
    asked = {1: "Kuveyt Türk'ün oranı?", 2: "albaraka ne sunar", 3: "albraka oranı", 4: "katılım bankaları", 5: "kuveyit turk ile ziraat", 6: "Türk", 7: None, 8: "", 9: "vakif katilim, ziraat katılım"}
    got = {(r.question_id, r.bank, r.step) for r in matching.recognised_in_steps(spark.createDataFrame(list(asked.items()), "question_id int, question string"), banks).collect()}
    assert got == {(1, "Kuveyt Türk", "name"), (2, "Albaraka Türk", "word"), (3, "Albaraka Türk", "near"), (5, "Ziraat Katılım", "word"), (9, "Vakıf Katılım", "name"), (9, "Ziraat Katılım", "name")}


def test_names_outside_the_registry(spark):
    asked = spark.createDataFrame([(1, "Akça Bankası'nın oranı"), (2, "kuzeybank mı?"), (3, "hangi banka"), (4, None), (5, "Deniz bank ve akça bank")], "question_id int, question string")
    got = matching.foreign(asked, spark.createDataFrame([("Akça Katılım",), (None,)], "bank string"))
    assert sorted(map(tuple, got.collect())) == [(2, "kuzeybank"), (5, "deniz")]


def test_cut_off_answers_products_and_segments(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1, "b": "x',), ('{"a"',), ("",), (None,), ('{"eligibility": {"segments": ["s"]}}',)], "j string")
    got = rows.select(matching.salvaged(F.col("j")), matching.in_segment(F.col("j"), "s"), matching.of_product("Taşıt", F.col("j"), F.lit("/tasit-kredisi"))).collect()
    assert [r[0] for r in got] == ['{"a": 1, "b": 2}', '{"a": 1}', None, None, None, '{"eligibility": {"segments": ["s"]}}']
    assert [r[1] for r in got] == [False] * 5 + [True] and all(r[2] for r in got)


def test_cookie_layers_are_not_body():
    page = '<div id="CookieBar"><div>We use<br> them</div><img>ok</div><p class="text">The <b>offer</b></p><section class="x consent-y">no</section>end'
    assert texts.body_text(page) == "The offer\nend"


def test_index_knows_its_corpus_and_model(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string")
    at = str(tmp_path / "index")
    vectors.written(spark.createDataFrame([(1, [0.5])], "vec_id int, embedding array<double>"), docs, "m", at)
    assert vectors.opened(spark, at, "m").count() == 1
    assert tuple(vectors.stale(spark, at, docs.orderBy(F.desc("doc_id"))).first()) == (False, 0)
    assert tuple(vectors.stale(spark, at, docs.where("doc_id = 1")).first()) == (True, -1)
    with pytest.raises(ValueError):
        vectors.opened(spark, at, "other")
