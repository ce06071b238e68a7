"""Each stage of the pipeline, and all of them, on awkward tables."""

import random

import pytest

import corpus_pipeline
from offerlens.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, row_key string, cut_key string, cut_text string, kept boolean"
AA, BB = [f"{a}{b}on" for a in "bcdfgh" for b in "aeiou"], [f"x{a}w{b}" for a in "klmnp" for b in "aeiouy"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(23)
    make = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, make(AA if i % 2 else BB, 60), "aa" if i % 2 else "bb") for i in range(80)]
    passage = make(AA, 60)
    out += [(100, out[1][1], "aa"), (101, out[1][1], "aa"), (102, None, "aa"), (103, "", None), (104, "12 34 -- 99", "bb"), (105, "漢字かな交じり文" * 20, None)]
    out += [(110, make(AA, 40) + " " + passage, "aa"), (111, make(AA, 40) + " " + passage, "aa"), (112, make(AA, 40000), None)]
    out += [(120, make(AA, 50), "aa"), (120, make(AA, 50), "aa"), (None, make(BB, 50), "bb"), (None, make(BB, 50), None)]
    near = out[3][1].split(" ")
    near[30] = "changed"
    out.append((130, " ".join(near), "aa"))
    return [(i, t, lang, "s", len(t or ""), "a", "b", "c", "d", False) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    return spark.read.parquet(f"{at}/documents.parquet"), at


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_language_stage_rejects_what_is_no_language(spark, docs, rows):
    got = corpus_pipeline.identify_language(spark, docs[0], docs[1])
    assert got.schema == docs[0].schema
    want = [r for r in rows if r[0] not in (102, 103, 104, 105)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_exact_stage_keeps_the_largest_id(spark, docs, rows):
    got = corpus_pipeline.exact_dedup(spark, docs[0], docs[1])
    assert got.columns == docs[0].columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for r in rows if r[0] not in (1, 100, 102)), key=key)


def test_near_stage_keeps_one_of_each_class(spark, docs, rows):
    got = corpus_pipeline.near_dedup(spark, docs[0], docs[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for r in rows if r[0] not in (100, 101, 130)), key=key)


def test_suffix_stage_keeps_all_rows_and_columns(spark, docs, rows):
    got = corpus_pipeline.suffix_dedup(spark, docs[0], docs[1])
    assert got.columns == docs[0].columns
    out = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(r.n_chars == len(r.text) and tuple(r)[5:] == ("a", "b", "c", "d", False) for r in out)
    text = {r.doc_id: r.text for r in out}
    whole = {r[0]: r[1] for r in rows}
    assert text[100] == text[101] == "" and text[1] == whole[1] and text[110] == whole[110] and len(text[111]) < len(whole[111]) - 250
    lone = sorted(r[1] for r in rows if r[0] in (120, None))
    assert sorted(r.text for r in out if r.doc_id in (120, None)) == lone


def test_packing_stage_gives_a_row_for_each(spark, docs, rows):
    assert corpus_pipeline.pack(spark, docs[0], docs[1]).count() == len(rows)


def test_run(spark, docs, rows):
    ids = [r.doc_id for r in corpus_pipeline.run(spark, docs[1]).collect()]
    want = [r[0] for r in rows if r[0] not in (1, 100, 101, 102, 103, 104, 105, 130)]
    assert sorted((i is None, i or 0) for i in ids if i != 101) == sorted((i is None, i or 0) for i in want)
    assert ids.count(101) == 1  # the copy that exact dedup kept


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries_keep_their_contracts(spark, docs, rows):
    """Each opN_ query over a table with nulls, repeats and clashing columns has a row for each document and the columns of its contract."""
    contract = {
        "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op2_language": "doc_id held_out lang_pred score", "op3_minhash": "doc_id class_id kept", "op4_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op5_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6_substring_dedup": "doc_id n_words n_removed kept_sha256", "op8_lm_scores": "doc_id n_words log_score n_backoff",
        "op9_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op10_packing": "doc_id n_tokens bucket padded_to batch_id slot",
    }
    for name, columns in contract.items():
        got = queries.QUERIES[name](spark, docs[1])
        assert got.columns[: len(columns.split())] == columns.split()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()) == sorted((r[0] is None, r[0] or 0) for r in rows), name
