"""Periodic runs, spelling variants and exact search: random cases against brute force, and the edge cases."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scaffweave.llm import periods, queries, spelling, topk


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 14))
def test_runs_of_a_list(words, least):
    assert [r for r in periods.word_runs(words, least) if r[1] >= max(least, 2 * r[2])] == brute.periodic_runs(words, least)


def texts():
    rng = random.Random(7)
    out = [None, "", " \t\n ", "one", "a " * 40, "x y " * 9 + "x", " \x00 é " * 8, "A a " * 12]
    for _ in range(60):
        w = [rng.choice("abc") if rng.random() < 0.9 else str(rng.random()) for _ in range(rng.randrange(120))]
        if w and rng.random() < 0.7:
            low, p = rng.randrange(len(w)), rng.randrange(1, 20)
            w[low:] = [w[low + k % p] if low + k % p < len(w) else "z" for k in range(len(w) - low)]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return [*out, out[20], " ".join(str(k % 997) for k in range(60_000)) + " end " + "b " * 20_000]


def test_runs_of_texts(spark):
    rows = [(None if i % 9 == 5 else i % 50, t, 3, "r", [i]) for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, collapsed string, tag array<int>").repartition(3)
    got = periods.find_runs(frame).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "tag", "n_words", "runs", "collapsed"]
    for r in got:
        w = brute.space_words(rows[r.tag[0]][1])
        found = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(w)
        if len(w) < 1000:
            assert found == brute.periodic_runs(w)
        else:
            assert found == [(0, 60_000, 997), (60_001, 20_000, 1)]
        assert r.collapsed == brute.collapsed(w, found)
    assert periods.find_runs(frame.limit(0)).count() == 0


def test_runs_keep_named_columns_and_other_lengths(spark):
    frame = spark.createDataFrame([(1, "a b a b a b", "t")], "k long, body string, runs string")
    got = periods.find_runs(frame, "body", ["k", "body"], least=4).first()
    assert (got.k, got.body, [tuple(x) for x in got.runs], got.collapsed) == (1, "a b a b a b", [(0, 6, 2)], "a b")


def test_tails_are_repeated_as_told(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 70))) for i in range(400)] + [(None, "a b c"), (20, None), (21, " \n ")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", queries.repeat_tails().alias("new")).collect()
    changed = 0
    for r in got:
        w = brute.repeated_tail(r.doc_id, r.text) if r.doc_id is not None else brute.space_words(r.text)
        assert brute.space_words(r.new) == w and (r.text is None) == (r.new is None)
        changed += r.text != r.new
    assert changed > 20


def words(n, seed, letters="abcdeé"):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
        out[w] = rng.choice([1, 2, 5, 30, 200, 2000])
    return out


@pytest.mark.parametrize("cell,tile", [(4096, 512), (20, 16)])
def test_variants_of_random_words(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "TILE", tile)
    given_words = words(1200, 3) | {"日本語": 9, "日本": 90, "x" * 3000: 5, "x" * 2999: 50, "aab\x00b": 4}
    frame = spark.createDataFrame([*given_words.items(), (None, 4), ("", 9), ("abc", None)], "word string, n long").withColumn("root", F.lit("r"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame).collect()}
    assert got == brute.spelling(given_words)
    assert any(form is not None and form != root for form, root, *_ in got.values())


def test_variants_add_repeated_words_and_take_empty_tables(spark):
    frame = spark.createDataFrame([("maison", 20), ("maison", 5), ("maisn", 5), ("mxison", 6), ("maisnx", 1)], "word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame).collect()}
    assert got == {"maison": (None, "maison", 25, 2, None), "maisn": ("maison", "maison", 5, 2, 25), "mxison": (None, "mxison", 6, 1, None), "maisnx": ("maisn", "maison", 1, 1, 5)}
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_misspelt_words(spark):
    rng = random.Random(5)
    pool = ["Straße", "straße", "ÉCOLES", "écoles", "a÷bcdefgh", "lettres", "Lettres", "letters", "abcde"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(60)) + "2nd x_y") for i in range(300)] + [(None, "lettres " * 9), (7, None), (8, ""), (8, "letters, letters")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: r.n for r in queries.misspelt_words(frame).collect()} == brute.letter_words(docs)


def same(got, expected):
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("least", [2048, 20])
def test_top_k_of_odd_vectors(spark, monkeypatch, least):
    monkeypatch.setattr(topk, "LEAST", least)
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, 8)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(120)] + [(10, rows[7][1]), (50, [0.0] * 8), (None, rows[50][1]), (0, rows[0][1])]
    rows += [(100, None), (100, []), (300, []), (350, [1.0]), (100, [float("nan")] * 8), (150, [float("inf")] + [0.0] * 7), (250, [None, *[0.5] * 7]), (400, [-3.0, 2.0]), (500, [1.0, 1.0]), (650, [-0.001, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(5)
    same(topk.exact_top_k(frame, F.col("vec_id") % 50 == 0).collect(), brute.top_k(rows, lambda v: v % 50 == 0))
    assert topk.exact_top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 7), st.integers(0, 10**6), st.sampled_from([1, 3, 40, 2000]))
def test_index_equals_products(n, dims, k, seed, spread):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-spread, spread + 1, (n, dims)), rng.integers(-spread, spread + 1, dims)
    own = int(rng.integers(-1, n))
    found, score = topk.ImpactIndex(x).top(q, k, own)
    expected = sorted((-int(x[i] @ q), i) for i in range(n) if i != own)[:k]
    assert list(zip((-score).tolist(), found.tolist(), strict=True)) == expected


def test_index_stops_before_its_end():
    """On many vectors the bound leaves few rows to be rescored; the result is that of all products."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 32, (20_000, 64))).astype(np.int64)
    index = topk.ImpactIndex(x)
    for own in range(0, 2000, 200):
        found, score = index.top(x[own], 5, own)
        all_scores = x @ x[own]
        all_scores[own] = -(2**62)
        best = np.lexsort((np.arange(len(x)), -all_scores))[:5]
        assert found.tolist() == best.tolist() and score.tolist() == all_scores[best].tolist()
