"""Each operator on small awkward tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import sys
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from offerlens.llm import automaton, bpe, exact, fingerprints, language, minhash, packing, repeats, scoring, suffixes, urls  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, block string, kept boolean, bucket string, rejected string"


def words(rng, n, size=60):
    return " ".join(rng.choice(VOCABULARY[:size]) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choices("abcdeéß", k=3 + i % 6)) for i in range(400)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    long = words(rng, 3000, 400)
    shared = words(rng, 60, 400)
    out = [None, "", " ", "\n\t", "12345 !!", "one", long, long, "x" * 1200, "ab" * 400, shared, shared, f"{words(rng, 50)} {shared} {words(rng, 50)}", f"{shared} {shared}", "é" * 150 + "ß" * 150]
    base = words(rng, 120, 400).split(" ")
    for k in range(6):
        own = list(base)
        own[10 * k] = "changed"
        out.append(" ".join(own))
    out += [words(rng, n, 12) for n in (3, 4, 5, 6, 40, 200)] + [words(rng, 80, 400) + "\n" + words(rng, 80, 400) for _ in range(6)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", "s", 0, "h", "b", False, "k", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def pairs(texts):
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_repeated_bytes(docs, pairs, none):
    want = brute.repeated_bytes(pairs)
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.without_repeated_bytes(docs).collect()}
    assert got == want
    assert repeats.without_repeated_bytes(none).count() == 0


def test_repeats_of_a_crowded_anchor(spark):
    """A line that all texts share, each going on differently, is searched by window digests: same result."""
    rng = random.Random(2)
    line = words(rng, 40, 400)
    rows = [(i, f"{words(rng, 30, 400)} {line} {words(rng, 30, 400)}" if i % 3 else line + words(rng, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for make, kind, want in ((repeats.without_repeated_bytes, repeats.BYTES, brute.repeated_bytes(rows)), (repeats.without_repeated_words, repeats.WORDS, brute.repeated_words(rows))):
        for limit, segment in ((2000, 1 << 19), (3, 1 << 19), (2000, 700), (3, 150)):
            got = {r.doc_id: tuple(r)[1 : 1 + len(want[0])] for r in make(df, kind=replace(kind, group_limit=limit, block_bytes=4000, segment=segment)).collect()}
            assert got == want


def test_each_window_has_one_owner_and_equal_windows_have_equal_ones():
    from offerlens.llm import digest

    rng = np.random.default_rng(11)
    for alphabet in (1, 2, 40):
        symbols = rng.integers(1, alphabet + 1, 900).astype(np.uint64)
        symbols[500:700] = symbols[100:300]
        ends = np.array([0, 40, 340, 340, 900])
        at, first, last, _, _ = digest.owners(symbols, ends, 6, 20)
        owner = {w: int(a) - w for a, x, y in zip(at, first, last) for w in range(x, y + 1)}
        inside = [w for w in range(881) if not any(w < e < w + 20 for e in ends)]
        assert sorted(owner) == inside and sum(last - first + 1) == len(inside)
        by_text: dict = {}
        for w in inside:
            by_text.setdefault(symbols[w : w + 20].tobytes(), set()).add(owner[w])
        assert all(len(places) == 1 and 0 <= min(places) <= 14 for places in by_text.values())


def test_equal_snippets_are_told_by_their_symbols_when_digests_collide(spark, monkeypatch):
    from offerlens.llm import blocks

    monkeypatch.setattr(repeats.Symbols, "digest", lambda self, a, b: np.zeros(len(a), np.uint64))
    text = "".join(random.Random(3).choices("abcd", k=400))
    raw = (text[:150] + text[:150] + text[150:]).encode()
    b = blocks.Block(blocks.squeeze(np.array([1]), np.zeros(0, np.int64), np.array([len(raw)]), np.frombuffer(raw, np.uint8)))
    s = next(repeats.Layout(b, repeats.BYTES).segments())
    for i in range(len(s.at)):
        assert s.content(i) == s.content(int(s.first[s.own_class[i]]))
    assert len(s.first) == len({(int(s.hash[i]), s.content(i)) for i in range(len(s.at))})


def test_repeated_words(docs, pairs, none):
    want = brute.repeated_words(pairs)
    got = {r.doc_id: tuple(r)[1:4] for r in repeats.without_repeated_words(docs).collect()}
    assert got == want
    assert repeats.without_repeated_words(none).count() == 0


def test_suffix_sort_matches_sorting_the_bytes():
    rng = np.random.default_rng(1)
    symbols = rng.integers(97, 99, 400).astype(np.uint8)
    at = rng.integers(0, 390, 120)
    size = np.minimum(rng.integers(1, 60, 120), 400 - at)
    edges = [0, 1, 3, 40, 120]
    start, stop = np.zeros(120, int), np.zeros(120, int)
    for a, b in zip(edges, edges[1:]):
        start[a:b], stop[a:b] = a, b
    order, common = suffixes.sort(symbols, at, size, start, stop)
    text = lambda i: symbols[at[i] : at[i] + size[i]].tobytes()
    for a, b in zip(edges, edges[1:]):
        own = [text(i) for i in order[a:b]]
        assert own == sorted(text(i) for i in range(a, b))
        for k in range(1, b - a):
            x, y = own[k - 1], own[k]
            assert common[a + k] == next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    """With a hash that says all spans are equal, the bytes decide."""
    monkeypatch.setattr(suffixes, "span", lambda pre, a, b: np.zeros(len(a), np.uint64))
    symbols = np.frombuffer(b"bananabandana", np.uint8)
    at = np.arange(13)
    order, common = suffixes.sort(symbols, at, 13 - at, np.zeros(13, int), np.full(13, 13))
    assert [bytes(symbols[i:]) for i in order] == sorted(bytes(symbols[i:]) for i in range(13))
    assert common.tolist()[:5] == [0, 1, 1, 3, 3]


def test_automaton_counts_like_counting():
    rng = random.Random(4)
    texts = [([rng.choice("ab") for _ in range(12)], rng.choice([1, 1, 2])) for _ in range(5)]
    a = automaton.Automaton()
    for t, n in texts:
        a.add(t, n)
    a.close()
    times = {}
    for t, n in texts:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                times[tuple(t[i:j])] = times.get(tuple(t[i:j]), 0) + n
    for t, _ in texts:
        want = [max((m for m in range(1, e + 2) if times[tuple(t[e + 1 - m : e + 1])] >= 2), default=0) for e in range(len(t))]
        assert a.repeated(t) == want


def test_near_duplicates(docs, pairs, none):
    want = brute.near_classes(pairs)
    rows = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == want and len(rows) == len(pairs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_chain_and_null_ids(spark):
    """Links through a middle text join ends that are not alike; wordless texts stay alone."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    chain = []
    for k in range(6):
        own = list(base)
        own[: 5 * k] = [f"v{i}" for i in range(5 * k)]
        chain.append(" ".join(own))
    rng.shuffle(chain)
    rows = [(10 + i, t) for i, t in enumerate(chain)] + [(1, ""), (2, None), (None, "a b c d e f"), (10, chain[0])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id and r.doc_id >= 10} == {10} and len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if not r.doc_id or r.doc_id < 10} == {1: 1, 2: 2, None: None}


def test_near_duplicates_in_crowded_buckets(spark):
    """Copies with so many edits that most are not alike: the same classes whether buckets are small or dealt in parts."""
    rng = random.Random(9)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(150)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute.near_classes(rows)
    assert len(set(want.values())) > 3
    for small, part in ((16, 512), (2, 7), (100, 7)):
        assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, small=small, part=part).collect()} == want


def test_probability_jaccard_is_what_signatures_estimate():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    x[:60], y[-60:] = 0, 0
    doc, elements, weights = np.repeat([0, 1], 300), np.concatenate([h, h]), np.concatenate([x, y])
    on = weights > 0
    sig = minhash.signatures(2, doc[on], elements[on], weights[on], 4096)
    both = (x > 0) & (y > 0)
    want = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in np.flatnonzero(both))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_bpe_round_trip(docs, pairs, none):
    t = bpe.load(path())
    more = bpe.encode(docs, path(), with_ids=True).collect()
    assert len(more) == len(pairs)
    texts = dict(pairs)
    for r in more:
        text = texts[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(none, path()).count() == 0


def test_bpe_splits_like_the_tokenizer():
    t = bpe.load(path())
    split = bpe.splitter(t)
    for text in ["a<|endoftext|> b", "don't  stop\n\n now", "\u088f\u0c5c x", "naïve\u00a0café 12,5", "<|endoftext|><|endoftext|>", "  lead", "trail  "]:
        ids = [i for w in split(text) for i in t.encode(w, add_special_tokens=False).ids]
        assert ids == t.encode(text, add_special_tokens=False).ids


def test_fingerprints(docs, pairs, none):
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(pairs)
    for k, (doc, text) in enumerate(order):
        t, f = text or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + f[:q]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        p = [set(zip(*(a.tolist() for a in fingerprints.paragraphs([x])))) for x in (t, e, f)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - like(p[0], p[1])) < 1e-12 and abs(r.near_next - like(p[0], p[2])) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (t == e)
        near, lost, gained = fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert near == r.near_edited and (lost, gained) == (sorted(r.lost), sorted(r.gained))
        digests = lambda a: sorted(np.array([h for _, h in a], np.uint64).view(np.int64).tolist())
        assert lost == digests(p[0] - p[1]) and gained == digests(p[1] - p[0])
        follower = rows[order[(k + 1) % len(order)][0]]
        assert fingerprints.likeness(r.fingerprint, follower.fingerprint)[0] == r.near_next
    assert fingerprints.fingerprints(none).count() == 0


def test_fingerprints_of_one_row_and_null_ids(spark):
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = fingerprints.fingerprints(spark.createDataFrame([(None, "abcd"), (1, "efgh"), (1, "efgh")], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and len({r.fingerprint for r in rows}) == 2


def test_language(spark, none):
    rng = random.Random(6)
    kinds = {"aa": VOCABULARY[:100], "bb": VOCABULARY[200:300]}
    rows = [(i, " ".join(rng.choice(v) for _ in range(60)), lang) for lang, v in kinds.items() for i in range(60)]
    df = spark.createDataFrame([*rows, (900, "12 34", "aa"), (901, None, "bb"), (902, "kein Label", None)], "doc_id long, text string, lang string")
    rows_text = {(lang, i): t for i, t, lang in rows}
    model = language.fit(df)
    got = language.identify(df, model, carry=["lang"]).collect()
    assert all(r.lang_pred == r.lang and not r.rejected for r in got if r.doc_id < 900)
    odd = {r.doc_id: r for r in got if r.doc_id >= 900}
    assert (odd[900].lang_pred, odd[900].score, odd[900].rejected) == ("und", 0.0, True) and odd[901].lang_pred == "und" and odd[902].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:  # the nearest centroid by plain cosine over all of them
        if r.doc_id < 900:
            v = np.log1p(language.counts(rows_text[r.lang, r.doc_id])) * model.idf
            cosines = model.centroids.astype(float) @ v / np.linalg.norm(v)
            assert r.lang_pred == model.langs[int(cosines.argmax())] and abs(r.score - cosines.max()) < 1e-4
    assert language.identify(none, model).count() == 0
    nothing = language.fit(none)
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.accepted(df, model).columns == df.columns and language.accepted(df, model).where("doc_id in (900, 901)").count() == 0


def test_language_learns_from_copies_of_one_text(spark):
    """Thousands of copies of one text are one text to learn from, not none and not all."""
    rng = random.Random(13)
    rows = [(" ".join(rng.choice(VOCABULARY[:100]) for _ in range(40)), "aa") for _ in range(300)] + [(" ".join(VOCABULARY[200:260]), "bb")] * 5000
    for seed in range(3):
        rows[-1] = (" ".join(VOCABULARY[200 + seed : 250 + seed]), "bb")
        model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
        assert set(model.langs) == {"aa", "bb"}


def test_held_out_documents_are_not_learned_from(spark, tmp_path):
    from zlib import crc32

    from offerlens.llm import queries

    rng = random.Random(17)
    kinds = {"aa": VOCABULARY[:100], "bb": VOCABULARY[200:300]}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(40)), lang, "s", 0) for i, lang in enumerate(["aa", "bb"] * 150)]
    rows = [(i, t, "secret" if crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows] + [(None, "x y z", "none", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_language(spark, str(tmp_path)).collect()
    assert len(got) == 301 and {r.lang_pred for r in got} == {"aa", "bb"}
    assert all(r.held_out == (r.doc_id is None or crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [r.lang_pred == ("aa" if r.doc_id % 2 == 0 else "bb") for r in got if r.held_out and r.doc_id is not None]
    assert len(right) > 50 and all(right)


def test_trees_judge_held_out_urls(spark):
    """Urls like those that rules block or allow, which no rule decides, are judged alike nine times in ten."""
    rng = random.Random(19)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    bad = lambda host: f"http://{word(4)}{rng.randrange(10**6)}.{host}/{rng.randrange(10**9)}?a={rng.randrange(99)}&b=1&c=2"
    good = lambda host, path: f"http://{host}/{path}/{word(6)}/{word(8)}.html"
    rows = [(i, bad("net")) for i in range(200)] + [(200 + i, good("w.org", "fr")) for i in range(200)]
    rows += [(1000 + i, bad("xyz")) for i in range(60)] + [(2000 + i, good("w.org", "en")) for i in range(60)] + [(3000, None), (3001, "")]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(rows) and all(got[i].rule for i in range(400)) and all(got[i].rule is None for i in got if i >= 1000)
    right = sum(got[1000 + i].verdict == "block" for i in range(60)) + sum(got[2000 + i].verdict == "allow" for i in range(60))
    assert right >= 108
    few = urls.judge(df, train_rows=40).where("page_id < 400").collect()
    assert all(r.verdict == got[r.page_id].verdict for r in few)


def test_urls(spark):
    rows = [
        (1, "http://a.example.net/en/x"), (2, "https://EXAMPLE.com/de/"), (3, "http://x.org/fr/1?q"), (4, "http://x.org/en/"), (5, None), (6, "no scheme"), (7, "http://"), (8, "ftp://net"), (9, "http://net/"), (10, "http://b.net#f"),
        (11, "http://notexample.com/de/"), (12, "http://m.example.com/de"), (13, "a://b://c.net/x"),
    ]
    rows += [(100 + i, f"http://w{i}.example.org/{'fr' if i % 2 else 'en'}/{i}") for i in range(40)] + [(200 + i, f"http://casino{i}.net/{i}") for i in range(40)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    want = {1: "example.net/en/", 2: "example.com/de/", 3: "org/fr/", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "net/", 10: None, 11: None, 12: None, 13: None}
    assert {k: got[k].rule for k in want} == want
    assert (got[5].host, got[5].path, got[6].host) == ("", "", "") and (got[2].host, got[2].path) == ("example.com", "/de/") and got[13].host == "b:"
    assert all(r.verdict in ("allow", "block") for r in got.values()) and got[1].verdict == "allow" and got[9].verdict == "block"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_scores(docs, pairs, none):
    tokens = {d: [w.decode() for w in brute.WORD.findall((t or "").encode())] for d, t in pairs}
    for order in (1, 2, 3):
        counts = {}
        for own in tokens.values():
            s = ["<s>"] * (order - 1) + own
            for n in range(1, order + 1):
                for i in range(n - 1, len(s)):
                    g = tuple(s[i - n + 1 : i + 1])
                    counts[g] = counts.get(g, 0) + 1
        total = sum(map(len, tokens.values()))
        for r in scoring.score(docs, order=order).collect():
            s, value, back = ["<s>"] * (order - 1) + tokens[r.doc_id], 0.0, 0
            for i in range(order - 1, len(s)):
                for n in range(order, 0, -1):
                    g = tuple(s[i - n + 1 : i + 1])
                    if n == 1:
                        value += np.log(counts[g] / total) + (order - 1) * np.log(0.4)
                        back += 1
                    elif counts[g] >= 2:
                        value += np.log(counts[g] / counts[g[:-1]]) + (order - n) * np.log(0.4)
                        break
            assert (r.n_words, r.n_backoff) == (len(s) - order + 1, back) and abs(r.log_score - value) < 1e-6 * max(1, abs(value))
    assert scoring.score(none).count() == 0


def test_exact(spark, docs, pairs, none):
    rows = exact.dedup(docs).collect()
    texts = {d: t or "" for d, t in pairs}
    for r in rows:
        same = [d for d, t in texts.items() if t == texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), r.doc_id == max(same), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert len(rows) == len(pairs) and exact.dedup(none).count() == 0


def test_exact_index_over_batches(spark):
    index = exact.DigestIndex(spark, buckets=4)
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r.kept for r in exact.dedup(batch((1, "a"), (2, "a"), (3, "b"), (None, "c")), index).collect()}
    assert first == {1: False, 2: True, 3: True, None: True}
    second = {(r.doc_id, r.keep_id): r.kept for r in exact.dedup(batch((9, "a"), (10, "d"), (10, "d")), index).collect()}
    assert second == {(9, 2): False, (10, 10): True} and index.read().count() == 4
    assert index.read().groupBy("digest").count().where("count > 1").count() == 0
    index.drop()


def test_packing(docs, pairs, none):
    rows = packing.pack(docs, budget=400, buckets=4).collect()
    lengths = {d: len(brute.WORD.findall((t or "").encode())) for d, t in pairs}
    assert {r.doc_id: r.n_tokens for r in rows} == lengths and len(rows) == len(pairs)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
        assert r.n_tokens <= r.padded_to
    for own in batches.values():
        assert len(own) == 1 or len(own) * max(1, own[0].padded_to) <= 400
        assert sorted(r.slot for r in own) == list(range(len(own))) and len({r.padded_to for r in own}) == 1
    assert packing.pack(none).count() == 0


def test_boundaries_are_the_best():
    from itertools import combinations

    rng = random.Random(7)
    for _ in range(20):
        tops = sorted(rng.sample(range(1, 60), 8))
        counts = [rng.randint(1, 9) for _ in tops]
        pad = lambda chosen: sum(n * (min(c for c in chosen if c >= t) - t) for t, n in zip(tops, counts))
        for most in (1, 2, 3, 5, 9):
            best = min(pad([*c, tops[-1]]) for k in range(min(most, 8)) for c in combinations(tops[:-1], k))
            assert pad(packing.boundaries(tops, counts, most)) == best


def test_buckets_are_padded_to_their_longest_member(spark):
    rows = [(i, n) for i, n in enumerate([5001, 5003, 3001, 7, 0, 70_001, 70_003, None])]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("text", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = {r.doc_id: r for r in packing.pack(df, budget=100_000, buckets=16, length_col="tokens").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: n or 0 for i, n in rows}
    assert all(r.padded_to == r.n_tokens for i, r in got.items() if r.n_tokens < 70_000)
    two = {r.doc_id: r.padded_to for r in packing.pack(df, buckets=2, length_col="tokens").collect()}
    assert set(two.values()) == {5003, 70_003}


def test_near_copies_whose_repeated_lines_differ_in_number(spark):
    """Each pair's set similarity is about 0.82, however often the line stands in one of the two."""
    rng, rows = random.Random(8), []
    for i in range(20):
        own = [f"w{i}x{k}x{rng.randrange(10**6)}" for k in range(68)]
        line = " ".join(own[60:])
        rows += [(2 * i, " ".join(own[:60])), (2 * i + 1, " ".join(own[:60]) + f" {line}" * 32)]
    sets = {d: set(zip(*(t.split()[k:] for k in range(5)))) for d, t in rows}
    linked = {2 * i for i in range(20) if len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) >= minhash.SIMILAR}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) == 20 and all(got[d + 1] == d for d in linked)


def test_repeated_and_null_rows_do_not_break(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, None), (None, "z" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for got in (repeats.without_repeated_bytes(df), repeats.without_repeated_words(df), bpe.encode(df, path()), scoring.score(df), packing.pack(df), exact.dedup(df), fingerprints.fingerprints(df), minhash.near_duplicates(df)):
        assert got.count() == 4


def test_no_query_reads_a_part():
    """The registered queries have no limit, sample or filter on ids."""
    source = (Path(__file__).parents[2] / "offerlens/llm/queries.py").read_text()
    assert not any(f".{word}(" in source for word in ("limit", "sample", "head", "take"))
    assert F is not None
