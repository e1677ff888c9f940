"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from scaffweave.llm import common, decontam, embeddings, language, minhash, packing, quality, sharding, substrings, toxicity, urls
from scaffweave.llm.queries import tokenizer_path

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, shard string, lang_pred string"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


LINE = words(1, 60)
NEAR = words(2, 200)
TEXTS = [
    None, "", "   \n\t ", "...!!!", "one two", "one two", LINE, "x " + LINE + " y", LINE, NEAR, NEAR + " end", "Zz " + NEAR,
    words(3, 40_000), words(3, 40_000) + " " + words(4, 20), "É\x00 ü\u2003日本 " + words(5, 70), words(6, 49), words(6, 50), words(6, 50).upper(), "a " * 300,
    "you are an idiot", "du bist ein trottel.", "\u2028" + LINE,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "xx", None, None, "w", "s", "h", "p") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def docs():
    return list(enumerate(TEXTS))


def test_repeats(odd, none, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(odd, with_text=True).collect()}
    assert got == brute.repeats(docs)
    assert substrings.remove_repeats(none).count() == 0
    kept = {r.doc_id: r.kept_text for r in substrings.remove_repeats(odd, with_text=True).collect()}
    assert kept[0] is None and kept[2] == TEXTS[2] and kept[8] == "" and kept[7] == "x y"


def test_repeats_in_a_hot_passage(spark):
    rows = [(i, f"{words(100 + i, 5)} {LINE} {words(200 + i, 55)}") for i in range(300)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)


def test_repeats_take_repeated_rows_and_null_keys(spark):
    rows = [(1, LINE), (1, LINE), (None, LINE), (2, "a")]
    got = sorted((r.doc_id is None, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 0), (False, 0), (False, 0), (True, 60)]


def test_near_duplicates(odd, none, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert got == brute.near_duplicates(docs)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 40)
    monkeypatch.setattr(minhash, "BUCKET", 60)
    rng = random.Random(4)
    base = words(9, 150).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_cells_bring_every_linkable_pair_together_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 7)
    rng = random.Random(5)
    size = {i: rng.randrange(20, 300) for i in range(150)}
    rows = [(1, i, n) for i, n in size.items()] + [(2, 1000 + i, 10 * i + 1) for i in range(5)]
    cells = {}
    for r in minhash._cells(spark.createDataFrame(rows, "component long, node long, n long"), 85).collect():
        cells.setdefault((r.component, r.c, r.i, r.d, r.j), []).append((r.node, r.side, r.whole))
    met = {}
    for key, own in cells.items():
        both = any(side for _, side, _ in own)
        for k, (a, x, _) in enumerate(own):
            for b, y, _ in own[:k]:
                if not both or x != y:
                    met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
        assert len(own) <= 60 and len({w for _, _, w in own}) == 1 and own[0][2] == (key[0] == 2)
    assert set(met.values()) == {1}
    for a in size:
        for b in size:
            if a < b and 100 * min(size[a], size[b]) >= 85 * max(size[a], size[b]):
                assert frozenset((a, b)) in met
    assert len(met) < 150 * 149 / 2  # pairs of too different sizes never meet


def test_near_duplicates_of_all_sizes_in_one_group(spark, monkeypatch):
    """A chain of ever longer texts: neighbours are linked, far ones are not, and the group spans many cells."""
    monkeypatch.setattr(minhash, "CELL", 12)
    monkeypatch.setattr(minhash, "BUCKET", 25)
    long = words(10, 900).split()
    rows = [(i, " ".join(long[: 60 + 5 * i])) for i in range(150)]
    rows += [(500 + i, " ".join([*long[: 60 + 5 * i], "end"])) for i in range(150)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_take_repeated_keys_and_clashing_names(spark):
    names = "doc_id long, text string, n long, node long, component long, print string, rep long, doc long"
    other = words(12, 80)
    rows = [(i, t, 1, 2, 3, "p", 4, 5) for i, t in [(5, NEAR), (5, other), (5, NEAR), (6, NEAR + " x"), (7, other + " y"), (None, NEAR), (8, None), (8, None)]]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, bool(r.kept)) for r in minhash.near_duplicates(spark.createDataFrame(rows, names)).collect())
    n, m = len(brute.shingles(NEAR)), len(brute.shingles(other))
    assert got == sorted([(5, n, 5, True), (5, n, 5, True), (5, m, 5, True), (6, n + 1, 5, False), (7, m + 1, 5, False), (-1, n, 5, False), (8, 0, 8, True), (8, 0, 8, True)])


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 500):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        s = minhash.sketch(x)
        assert (s != np.iinfo(np.uint64).max).all()
        assert np.array_equal(s, minhash.sketch(x[::-1].copy()))
    shares = []
    for _ in range(60):
        both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        a, b = np.unique(both[:850]), np.unique(both[150:])
        shares.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(shares) - 0.7) < 0.02


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    truth = brute.components({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert got == truth
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(odd, none):
    model = language.fit_prototypes(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    got = {r.doc_id: r for r in language.identify_languages(odd, model).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        lettered = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not lettered) and 0 <= got[i].score <= 1
    assert language.identify_languages(none, model).count() == 0
    assert {r.lang_pred for r in language.identify_languages(odd, language.fit_prototypes(none)).collect()} == {"und"}


def test_languages_are_told(spark):
    rows = [(i, words(i, 40) if i % 2 else words(i, 40).translate(str.maketrans("abcdefghij", "klmnopqrst")), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_languages(docs, language.fit_prototypes(docs)).collect()
    assert all(r.lang == r.lang_pred for r in got)


@pytest.mark.parametrize("remembered", [40, 40_000])
def test_hyperdimensional_vectors_by_brute_force(remembered):
    """Vectors of texts of several scripts against a plain sum over trigrams of bound letter vectors."""
    encoder = language.Encoder(dim=256, remembered=remembered)
    texts = [None, "", "12 ..", "Zoë naïve zoë", "Ωραία μέρα", "привет Мир", "日本語の文章 です", words(3, 200), "".join(chr(0x4E00 + 7 * i) for i in range(400)), "aΑа" * 50]
    got, lettered = encoder.encode(*common_buffer(texts))

    def letter(c):
        low = c.lower()[0]
        if not low.isalpha():
            return None
        return np.random.default_rng([encoder.seed, ord(low)]).choice(np.array([-1, 1], np.int8), 256).astype(float)

    for i, text in enumerate(texts):
        own = [letter(c) for c in text or ""]
        ones = np.ones(256)
        at = lambda k: ones if not 0 <= k < len(own) or own[k] is None else own[k]  # noqa: B023, E731
        v = sum((np.roll(at(k - 1), 2) * np.roll(at(k), 1) * at(k + 1) for k in range(len(own)) if own[k] is not None), np.zeros(256))
        assert lettered[i] == any(x is not None for x in own)
        size = np.linalg.norm(v)
        assert np.allclose(got[i], v / size if size else v, atol=1e-5)


def test_language_is_the_nearest_prototype(spark):
    """lang_pred and score against cosines that are worked out here, ties to the first name, with a null key and repeated rows."""
    texts = [words(i, 30) for i in range(20)] + [None, "12"]
    table = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, score string")
    vectors, _ = language.Encoder().encode(*common_buffer(texts))
    prototypes = np.stack([vectors[0], vectors[1], vectors[1]])
    got = language.identify_languages(table, (["aa", "bb", "cc"], prototypes)).collect()
    assert len(got) == 2 * len(texts)
    cosines = vectors @ prototypes.T
    for r in got:
        i = r.doc_id or 0
        if i >= 20:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ["aa", "bb", "cc"][int(cosines[i].argmax())] and abs(r.score - max(0, cosines[i].max())) < 1e-5
    assert "cc" not in {r.lang_pred for r in got}


def test_packing(odd, none, docs):
    got = packing.pack(packing.pieces(odd, tokenizer_path())).collect()
    assert {r.doc_id for r in got} == set(range(len(TEXTS)))
    assert [r.length for r in got if r.doc_id == 0] == [1]
    assert packing.pack(packing.pieces(none, tokenizer_path())).count() == 0
    fills = {}
    for r in got:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fills.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_grouping_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 400)
    parents = [packing.first_parent(lengths, rng, 0.1) for _ in range(3)]
    for bins in [packing.cross(parents[0], parents[1], lengths, rng), *packing.evolve(lengths, parents, rng, 5)]:
        fills = packing.fill(bins, lengths)
        assert len(bins) == 400 and fills.sum() == lengths.sum() and 0 < fills.min() and fills.max() <= 2048


def test_crossover_saves_bins_on_hard_lengths():
    """Triples that fill a sequence exactly: best fit by length wastes one bin in seven, children of whole bins less."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        a = rng.integers(780, 1000, 40)
        b = np.array([rng.integers(520, 2048 - x - 520) for x in a])
        lengths = np.sort(np.concatenate([a, b, 2048 - a - b]))
        parents = packing.found(lengths, [], rng, packing.POPULATION, 0.02)
        best = min(int(p.max()) + 1 for p in parents)
        child = packing.evolve(lengths, parents, rng)[0]
        fills = packing.fill(child, lengths)
        assert len(parents) == packing.POPULATION >= 8
        assert len(fills) < best and fills.max() <= 2048 and fills.sum() == lengths.sum()
    easy = np.full(64, 1024)
    assert len(packing.found(easy, [], rng, 8, 0.02)) == 1  # nothing is left to evolve


def test_packing_takes_ties_repeated_rows_and_clashing_names(spark):
    text = words(8, 30)
    rows = [(7, text, 1, 2, "x")] * 40 + [(None, text, 1, 2, "x")] * 3 + [(8, None, 1, 2, "x")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, piece int, length long, ids_crc32 string")
    got = packing.pack(packing.pieces(table, tokenizer_path())).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start) for r in got) == sorted((r[0] or 0, 0, 0) for r in rows)
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(rows)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) == -(-total // 2048)


def test_tokenizer_words():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    letters = "abcXYZ éÉß'’.,!<|>  \n\t09½§İıŒǅ漢字\u0301\u00a0\u2028s t ll×÷ɏɐ\x7f\x00"
    texts = [*TEXTS, "It's <|endoftext|> don't we'll\tx İstanbul ΑΣ ﬁ é ８ 3rd a1b2 ''s naïve ŉ ß ẞ", "<|STARTOFTEXT|><|startoftext|>", "ab " * 400_000 + "é" * 5000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    raw, offsets = common_buffer(texts)
    for remembered in (50, 600_000):
        coder = packing.TextTokenizer(tokenizer, remembered=remembered)
        ids, at = coder.encode(raw, offsets)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
        assert coder.kind is packing._KIND and len(coder.hashes) <= max(remembered, 200_000)


def test_tokenizer_of_another_kind():
    """A tokenizer that cuts texts in another way is told by the probe, and its chunks go through it whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    coder = packing.TextTokenizer(tokenizer)
    assert coder.kind is not packing._KIND
    ids, at = coder.encode(*common_buffer(["it's"]))
    assert ids.tolist() == tokenizer.encode("it's", add_special_tokens=False).ids


def common_buffer(texts):
    import pyarrow as pa

    from scaffweave.llm.words import text_buffer

    return text_buffer(pa.array(texts, pa.large_string()))


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(odd, model).collect()}
    assert got[19] > got[0] == got[1] and got[20] > got[1] and len(got) == len(TEXTS)
    assert toxicity.score_toxicity(none, model).count() == 0


def clause_label(words):
    """The label of a clause, by looking back from every word."""
    g = toxicity
    back = lambda k, n: range(max(0, k - n), k)
    first = list(words)
    for k, w in enumerate(words):
        if w == g.THREAT:
            first[k] = g.OTHER
        if w == g.TARGET:
            near = [j for j in back(k, 4) if words[j] == g.THREAT]
            if near and g.TARGET not in words[near[-1] : k]:
                meant = any(words[j] == g.INTENT for j in back(near[-1], 4))
                first[k] = "intended menace" if meant else "menace"
    second = list(first)
    aims = (g.TARGET, "menace", "intended menace")
    for k, w in enumerate(first):
        if w == g.INSULT:
            second[k] = "aimed" if any(first[j] in aims for j in back(k, 4)) else "bare"
        if w == g.TARGET:
            near = [j for j in back(k, 2) if first[j] == g.INSULT]
            if near and not any(first[j] in aims for j in range(near[-1], k)):
                second[k] = "aimed"
    found = []
    for k, w in enumerate(second):
        if w in g.LABELS:
            if any(words[j] == g.REPORT for j in back(k, 8)):
                w = "reported"
            elif any(words[j] == g.NEGATION for j in back(k, 6)):
                w = "negated"
            found.append(g.LABELS.index(w))
    return g.LABELS[max(found)] if found else g.OTHER


def test_grammar_by_brute_force():
    rng = random.Random(2)
    fst = toxicity.grammar()
    parts = (toxicity.threat(), toxicity.insult(), toxicity.marker(toxicity.NEGATION, 6, "negated"), toxicity.marker(toxicity.REPORT, 8, "reported"), toxicity.strongest())
    seen = set()
    for _ in range(6000):
        clause = [rng.choice(toxicity.BASE) if rng.random() < 0.5 else toxicity.OTHER for _ in range(rng.randrange(1, 16))]
        step = clause
        for part in parts:  # composed, they do what they do one after another
            step = part.run(step)
        assert fst.run(clause) == step
        assert step[-1] == clause_label(clause), clause
        seen.add(step[-1])
    assert seen == {*toxicity.LABELS, toxicity.OTHER}


#: Sentences and whether they are toxic; the fixed word classes alone, nothing learned.
SENTENCES = [
    ("You are an idiot.", 1), ("What an idiot you are!", 1), ("I will kill you.", 1), ("We are going to hurt him and his dog.", 1), ("Du bist ein Trottel.", 1), ("Je vais te frapper toi", 1),
    ("you stupid, worthless moron", 1), ("She is trash; he is scum", 1),
    ("The word idiot is old.", 0), ("idiot. idiot! idiot? idiot", 0), ("You are not an idiot.", 0), ("He said that you are an idiot.", 0), ("kill the process, then attack the queen", 0), ("Take out the trash.", 0),
    ("They never called you a moron", 0), ("trash trash trash trash", 0), ("It is not true that they will kill you", 0), ("", 0), ("The loser shakes hands.", 0),
]


def test_clauses_not_words(spark):
    """Isolated words, also repeated ones, score below 0.7; a count of listed words does much worse than the grammar."""
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(i, t) for i, (t, _) in enumerate(SENTENCES)] + [(100, "idiot " * 5000), (101, "idiot.\n" * 5000), (102, None), (0, SENTENCES[0][0])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in toxicity.score_toxicity(table, toxicity.fit_toxicity(table, nothing)).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score
    bad = {*toxicity.INSULTS, *toxicity.THREATS}
    counted = [any(w.strip(".,;!?").lower() in bad for w in t.split()) for t, _ in SENTENCES]
    assert [(t, int(got[i] >= 0.7)) for i, (t, _) in enumerate(SENTENCES)] == SENTENCES
    assert got[100] == got[101] < 0.7 and got[102] == got[17]
    assert sum(c != y for c, (_, y) in zip(counted, SENTENCES, strict=True)) >= 8


def test_learning_texts_are_bounded(spark):
    rows = [(1, f"text {i}") for i in range(50)] + [(2, "a"), (2, "a"), (3, "b" * 70_000), (4, None), (None, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, y int")
    texts, y = common.learning_texts(table, chosen, "doc_id", "text", 10)
    assert len(texts) == common.KEY_ROWS + 2 == len(y) and texts[-2:] == ["a", "b" * 70_000]


def test_long_texts_teach_too(spark, monkeypatch):
    """A corpus of long texts gives as many of them as the bytes allow, each by its first characters."""
    monkeypatch.setattr(common, "LEARNED", 1000)
    monkeypatch.setattr(common, "LEARN_BYTES", 20_500)
    table = spark.createDataFrame([(i, f"{i} " * 9000) for i in range(100)], "doc_id long, text string")
    chosen = table.selectExpr("doc_id", "cast(doc_id % 2 as int) y")
    texts, y = common.learning_texts(table, chosen, "doc_id", "text", 100)
    assert len(texts) == 20 and all(len(t) == 1000 for t in texts)
    assert [int(t.split()[0]) % 2 for t in texts] == y.tolist() and 0 < y.sum() < 20


def test_a_third_of_null_keys_is_dealt_like_others(spark):
    """Buckets of op8 and chunks of op1 where a third of all ids are null; results stay the same."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) doc_id", "concat('t ', id) text")
    sized = docs.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    counts = [r["count"] for r in sized.groupBy(sharding.slot_bucket(F.col("doc_id"), F.col("size"), F.col("crc"), 16)).count().collect()]
    assert len(counts) == 16 and max(counts) < 2 * np.median(counts)
    slots = {}
    for r in sharding.assign_shards(docs, 5).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"n{i} {passage} {i}") for i in range(30)] + [(5, f"five {passage}"), (9, passage)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([*[(None, 62, 60)] * 30, (5, 61, 0), (9, 60, 60)], key=str)


def test_shards_by_a_second_implementation_of_the_hash(spark):
    import math
    import struct

    import xxhash

    def score(shard, key, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), 42)
        if key is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        return -weight / math.log(((h >> 11) + 0.5) / 2**53)

    def best(key, weights):
        return max((score(i, key, w), i) for i, w in enumerate(weights))[1]

    docs = spark.range(-50, 250).selectExpr("if(id = 0, null, id * 1234567) doc_id", "'x' text")
    for weights in ([1.0] * 24, [1.0, 2.0, 0.5]):
        for r in sharding.assign_shards(docs, len(weights), weights).collect():
            assert (r.shard, r.grown_shard) == (best(r.doc_id, weights), best(r.doc_id, [*weights, sum(weights) / len(weights)]))


def quality_features(text):
    """The features of a text as strings, kind by kind."""
    w = brute.space_words(text)
    out = [list(w), list(zip(w, w[1:], strict=False)), [("first", a[:2], b[:2]) for a, b in zip(w, w[1:], strict=False)], [("last", a[-2:], b[-2:]) for a, b in zip(w, w[1:], strict=False)]]
    line = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
    for n in (2, 3, 4):
        out.append([line[k : k + n] for k in range(len(line) - n + 1) if " " not in line[k + 1 : k + n - 1]])
    return out


def test_quality_features_by_brute_force():
    texts = [*TEXTS[:12], *TEXTS[14:], "日本 語 \t\t é e\u0301 x", " a ", "ab", "x y", "ab ab ab\nab"]
    raw, offsets = common_buffer(texts)
    groups = quality.features(raw, offsets)
    assert len(groups) == 7
    bucket = {}
    for kind, (f, begin, end) in enumerate(sorted(groups, key=lambda g: 0)):
        for i, text in enumerate(texts):
            want = quality_features(text)[kind]
            own = f[begin[i] : end[i]].tolist()
            assert len(own) == len(want), (kind, text)
            for name, b in zip(want, own, strict=True):
                assert bucket.setdefault((kind, name), b) == b
    assert len(set(bucket.values())) > 0.95 * len(bucket)


def test_quality_scores_by_brute_force(spark):
    texts = [None, "", "one two", "two one two", words(5, 40), "é " * 30]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.train([t or "" for t in texts], np.array([0, 1, 0, 1, 0, 1]))
    got = {r.doc_id: r.score for r in quality.score_quality(table, model).collect()}
    for i, text in enumerate(texts):
        groups = [model["weights"][f[b[0] : e[0]]].astype(float) for f, b, e in quality.features(*common_buffer([text]))]
        means = [g.mean() for g in groups if len(g)]
        want = 1 / (1 + np.exp(-(np.mean(means) + model["bias"]))) if means else model["prior"]
        assert abs(got[i] - want) < 1e-6


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(odd, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(odd, model).collect()}
    assert len(got) == len(TEXTS) and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    assert quality.score_quality(none, quality.fit_quality(none, labels)).count() == 0


def test_contamination(spark, odd, none, docs):
    items = [(1, " ".join(NEAR.split()[20:45])), (2, "one two"), (3, None), (4, ""), (5, "..."), (6, words(6, 49)), (7, LINE.upper()), (7, LINE), (None, "a a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.items), decontam.items_digest(r["items"]), r.n_hit > 0) for r in decontam.find_contamination(odd, benchmark).collect()}
    assert got == brute.contamination(docs, items[:-1])
    assert decontam.find_contamination(none, benchmark).count() == 0
    assert {r.n_hit for r in decontam.find_contamination(odd, spark.createDataFrame([], "item_id long, text string")).collect()} == {0}


def test_contamination_in_passes(spark, odd, docs, monkeypatch):
    monkeypatch.setattr(decontam, "PHRASE_BYTES", 100)
    items = [(i, " ".join(NEAR.split()[i : i + 14])) for i in range(0, 60, 3)]
    found = decontam.find_contamination(odd, spark.createDataFrame(items, "item_id long, text string")).collect()
    truth = brute.contamination(docs, items)
    assert {r.doc_id: (r.n_hit, len(r["items"])) for r in found} == {d: t[1:3] for d, t in truth.items()}


def test_passes_give_what_one_pass_gives(spark, odd, docs, monkeypatch):
    items = [(i % 7, " ".join(NEAR.split()[i : i + 5 + i])) for i in range(0, 40, 2)] + [(8, LINE), (9, "one"), (10, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wide = odd.withColumns({c: F.lit("own") for c in ("n_hit", "__row", "__hit", "__items")})

    def found():
        return sorted((tuple(r) for r in decontam.find_contamination(wide, benchmark).collect()), key=repr)

    one = found()
    monkeypatch.setattr(decontam, "PHRASE_BYTES", 64)
    assert found() == one
    assert decontam.find_contamination(wide.limit(0), benchmark).count() == 0


def test_windows_of_a_benchmark():
    rng = np.random.default_rng(3)
    items = [(f"i{i}", " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 25)))) for i in range(60)] + [("i0", "a b"), ("z", None)]
    vocabulary, rows, lengths, (begins, owners), ids, shortest = decontam.phrases_of(items)
    letters = {int(np.searchsorted(vocabulary, h)) + 1: w for w in "abc" for h in [decontam.phrases_of([("x", w)])[0][0]]}
    truth = {}
    for i, (_, text) in enumerate(items):
        own = (text or "").split()
        for k in range(max(1, len(own) - 9) if own else 0):
            truth.setdefault(tuple(own[k : k + 10]), set()).add(i)
    got = {tuple(letters[s] for s in row[10 - n :].tolist()): set(owners[a:b].tolist()) for row, n, a, b in zip(rows, lengths, begins[:-1], begins[1:], strict=True)}
    assert got == truth and len(rows) == len(truth)
    assert ids == [k for k, _ in items] and shortest == min(map(len, truth))


@pytest.mark.parametrize("seed", range(5))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, 300)
    index = decontam.FMIndex(text, 4)
    phrases = np.zeros((30, 5), np.int64)
    lengths = rng.integers(1, 6, 30)
    for i, n in enumerate(lengths):
        phrases[i, 5 - n :] = rng.integers(0, 4, n)
    low, high = index.search(phrases, lengths)
    phrase, position = index.locate(low, high)
    got = sorted(zip(phrase.tolist(), position.tolist(), strict=True))
    truth = [(i, k) for i, n in enumerate(lengths) for k in range(300 - n + 1) if (text[k : k + n] == phrases[i, 5 - n :]).all()]
    assert got == sorted(truth)


def test_urls(spark):
    odd_urls = [None, "", "no", "http://", "http://COM/x", "http://a.Example.com:80/en/x?/y", "https://www.example.com/en/#a", "ftp://u@x.net/es/", "http://net/fr", "http://x.com", "a://b.net/fr/://c", "http://www.example.com/en/"] * 2
    pages = spark.createDataFrame([(i // 2 if i > 20 else i, u, "h", "r", "v") for i, u in enumerate(odd_urls)], "page_id long, url string, host string, rule string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge_urls(pages, urls.rules_frame(spark)).collect())
    truth = []
    for r in pages.collect():
        h, p, rule, v = brute.url_verdict(r.url, urls.RULES)
        truth.append((r.page_id, h, p, rule or "", v))
    assert got == sorted(truth)
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge_urls(pages, nothing).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), urls.rules_frame(spark)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("entry"))
    held = urls.bloom_filter(listed, "entry")
    assert listed.filter(~urls.may_hold(held, F.col("entry"))).count() == 0
    other = spark.range(5000).select(F.concat(F.lit("g"), "id").alias("entry"))
    assert other.filter(urls.may_hold(held, F.col("entry"))).count() < 250


def test_sharding(spark, odd, none):
    got = sharding.assign_shards(odd, 5, [1, 1, 1, 1, 4]).collect()
    assert {r.doc_id: r.size for r in got} == {i: len((t or "").encode()) + 8 for i, t in enumerate(TEXTS)}
    assert sharding.assign_shards(none).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.assign_shards(many, 5, [1, 1, 1, 1, 4]).groupBy("shard").count().collect()}
    assert abs(counts[4] / 20_000 - 0.5) < 0.02
    twins = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b")], "doc_id long, text string")
    rows = sharding.assign_shards(twins).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 30)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    x[100:200] = x[0] + 0.02 * rng.standard_normal((100, 16))
    x[200:240:2] = x[201:241:2] + 0.01 * rng.standard_normal((20, 16))
    x[300:320] = x[299] * 2.0
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 16, 0), (503, [float("nan")] + [1.0] * 15, 0), (504, [None] + [1.0] * 15, 0), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (506, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = brute.components(range(400), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert {i: got[i] for i in range(400)} == {i: (int(near[i].sum()), comp[i]) for i in range(400)}
    assert [got[i] for i in (500, 501, 502, 503, 504)] == [(0, i) for i in (500, 501, 502, 503, 504)]
    assert got[505] == (2, 505) and got[506] == (2, 505)
    assert embeddings.embedding_links(frame.limit(0)).count() == 0


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_links(x):
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = brute.components(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    return {i: (int(near[i].sum()), comp[i]) for i in range(len(x))}


@pytest.mark.parametrize("run", [256, 24])
def test_embeddings_of_clumps_that_fill_every_list(spark, monkeypatch, run):
    monkeypatch.setattr(embeddings, "RUN", run)
    rng = np.random.default_rng(1)
    x = unit_rows(rng.standard_normal((420, 48)))
    for low in (0, 60, 120):
        centre = x[300] + (0 if low == 0 else 0.29) * unit_rows(rng.standard_normal((1, 48)))[0]
        x[low : low + 60] = centre / np.linalg.norm(centre) + 0.09 * unit_rows(rng.standard_normal((60, 48)))
    x = unit_rows(x)
    near = x @ x.T
    assert near[:60, :60].min() > 0.97 and 0.94 < near[:60, 60:120].mean() < 0.97
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(x)


def test_neighbour_graph_goes_on_where_links_are_sparse(spark):
    rng = np.random.default_rng(5)
    x = unit_rows(rng.standard_normal((4000, 12)))
    x[:12] = unit_rows(x[100:112] + 0.3 * unit_rows(rng.standard_normal((12, 12))))
    cos = np.triu(x @ x.T, 1)
    truth = set(zip(*(v.tolist() for v in np.nonzero(cos >= 0.945)), strict=True))
    vectors = spark.createDataFrame([(i, v.tobytes(), i) for i, v in enumerate(x)], "rep long, unit binary, group long")
    _, edges = embeddings.neighbour_graph(vectors, k=10, tables=2, rounds=8, cosine=0.945)
    assert len(truth) == 21 and truth <= {(min(r), max(r)) for r in edges.collect()}


def test_audit_counts_small_groups_beside_a_hot_one(spark):
    rng = np.random.default_rng(6)
    x = unit_rows(rng.standard_normal((1500, 16)))
    x[1:40:2] = unit_rows(x[:40:2] + 0.1 * unit_rows(rng.standard_normal((20, 16))))
    classes = spark.createDataFrame([(i, v.tobytes(), 5000 if i < 2 else 1) for i, v in enumerate(x)], "rep long, unit binary, n long")
    hot = spark.createDataFrame([(i, 5000, 1, 0) for i in (0, 1)], "rep long, links long, pairs long, component long")
    assert embeddings.recall(hot, classes, 128) < 0.5
    assert embeddings.recall(spark.createDataFrame([(i, 1, 1, i // 2 * 2) for i in range(40)], hot.schema), classes, 128) == 1


def test_embeddings_count_null_and_repeated_keys(spark):
    """A null key is a vector like others; different vectors with one key both keep their links."""
    rng = np.random.default_rng(8)
    x = unit_rows(rng.standard_normal((6, 16)))
    near = unit_rows(x[2:3] + 0.02 * unit_rows(rng.standard_normal((1, 16))))[0]
    rows = [(1, x[0]), (None, x[0]), (None, x[0]), (None, x[1]), (None, x[1]), (9, x[2]), (9, x[3]), (4, near), (None, 2 * near), (7, x[3]), (None, None)]
    frame = spark.createDataFrame([(k, None if v is None else [float(c) for c in v]) for k, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embeddings.embedding_links(frame).collect())
    want = [(1, 2, 1, True), *[(-1, 2, 1, None)] * 2, *[(-1, 1, -1, None)] * 2, (9, 2, 4, False), (9, 1, 7, False), (4, 2, 4, True), (-1, 2, 4, None), (7, 1, 7, True), (-1, 0, -1, None)]
    assert got == sorted(want, key=lambda r: r[:3])


def test_recall_is_told_and_never_assumed(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ASKED", 64)
    rng = np.random.default_rng(9)
    x = unit_rows(rng.standard_normal((900, 24)))
    frame = lambda v: spark.createDataFrame([(i, [float(c) for c in u]) for i, u in enumerate(v)], "vec_id long, embedding array<double>")
    report = {}
    assert all(r.n_links == 0 for r in embeddings.embedding_links(frame(x), report=report).collect()) and report == {192: None}
    x[1] = unit_rows(x[:1] + 0.05 * unit_rows(rng.standard_normal((1, 24))))[0]  # one pair, which few of those asked would be in
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(frame(x), report=report).collect()}
    assert got == brute_links(x) and report == {192: 1.0}


def test_planted_pairs_through_the_registered_query(spark, tmp_path):
    from scaffweave.llm.queries import QUERIES

    rng = np.random.default_rng(10)
    x = rng.standard_normal((1200, 32))
    for i in range(0, 120, 3):
        x[i + 1] = x[i] + 0.25 * rng.random() * rng.standard_normal(32)
        x[i + 2] = x[i + 1] + 0.2 * rng.random() * rng.standard_normal(32)
    x[400:460] = x[399] + 0.15 * rng.standard_normal((60, 32))
    x[500:700] = x[499]
    spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op6_embedding_dedup"](spark, str(tmp_path)).collect()}
    assert got == brute_links(unit_rows(x.astype(np.float32).astype(np.float64)))


def test_embeddings_are_compared_whole_if_graphs_fail(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 200)
    monkeypatch.setattr(embeddings, "_edges", lambda vectors, *_: vectors.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    rng = np.random.default_rng(7)
    x = unit_rows(rng.standard_normal((700, 16)))
    x[1:40:2] = unit_rows(x[:40:2] + 0.1 * unit_rows(rng.standard_normal((20, 16))))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(x)


def test_dedup_stage_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    a, b, c, d = (words(300 + i, 120) for i in range(4))
    rows = [(None, a), (None, b), (None, b + " end"), (None, None), (7, c), (7, d), (7, d), (9, c + " end"), (None, c), (5, d + " end"), (3, "")]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in p.minhash_dedup(spark, frame, "").collect()]
    near_b = [r for r in got if r in ((None, b), (None, b + " end"))]
    assert len(near_b) == 1
    assert sorted(set(got) - set(near_b), key=str) == sorted([(None, a), (None, None), (7, c), (5, d + " end"), (3, "")], key=str) and len(got) == 6


def test_near_duplicates_at_another_threshold(spark):
    assert (minhash.band_rows(85), minhash.agreement(85), minhash.band_rows(80), minhash.agreement(80)) == (5, 85, 4, 76)
    rows = []
    for i in range(40):
        w = words(400 + i, 54).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:20], "edited", *w[21:]]))]  # 45 / 55 = 0.818
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id // 2 * 2 for r in minhash.near_duplicates(frame, percent=80).collect())
    assert all(r.kept for r in minhash.near_duplicates(frame).collect())
