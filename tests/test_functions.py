import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from scaffweave.functions import formatting, sequence, stats, tags
from scaffweave.params import ScaffoldParams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("values,q,expected", [([1, 2, 3, 4], 0.5, 2.5), ([1, 2, 3, 4, 5], 0.5, 3.0), ([10, 20], 0.01, 0.01 * 10 + 0.99 * 20), ([7], 0.99, 7.0)])
def test_quantile_has_swapped_weights(spark, values, q, expected):
    assert one(spark, stats.swapped_quantile(F.array(*map(F.lit, values)), q)) == pytest.approx(expected)


@pytest.mark.parametrize("most,total,passes", [(3, 3, True), (2, 2, False), (5, 5, True), (4, 5, False), (6, 7, True), (7, 8, True), (8, 10, True), (7, 10, False), (59, 100, True), (58, 100, False), (0, 0, False)])
def test_first_significant_counts(spark, most, total, passes):
    assert one(spark, stats.significant(F.lit(most), F.lit(total), ScaffoldParams().z)) is passes


def test_normal_cdf(spark):
    for x, n in ((5, 10), (8, 10), (14, 20)):
        exact = 0.5 * (1 + math.erf((x - n / 2) / (math.sqrt(n / 4) * math.sqrt(2))))
        assert one(spark, stats.normal_cdf(F.lit(x), 0.5, F.lit(n))) == pytest.approx(exact, abs=2e-7)


def test_ties_for_the_best_do_not_contest(spark):
    counts = [F.lit(x) for x in (5, 5, 0, 0)]
    most, place = stats.max_and_index(counts)
    assert (one(spark, most), one(spark, place), one(spark, stats.second_largest(counts))) == (5, 0, 0)


def test_barcode_tags(spark):
    bx = lambda s: one(spark, tags.bx_from_tags(F.lit(s)))
    assert bx("NM:i:3\tBX:Z:TTGACC-2\tMD:Z:7A2") == "TTGACC-2" and bx("XA:Z:q BX:Z:GGA-1 NM:i:0") == "GGA-1"
    assert bx("XT:i:0") == "" and bx("BX:Z:A-1\tX") == "A-1"
    assert one(spark, tags.bx_from_comment(F.lit("BX:Z:A-1\tX y"))) == "A-1\tX"
    assert one(spark, tags.barcode_from_name(F.lit("r_1_ACgt"))) == "ACgt"
    assert one(spark, tags.barcode_from_name(F.lit("r_1_ACX"))) == ""
    for name, out in (("r1/1", "r1"), ("r/x/2y", "r/x"), ("r/x", "r/x"), ("r", "r")):
        assert one(spark, tags.strip_read_num(F.lit(name))) == out


def test_identity(spark):
    f = lambda cigar, t: one(spark, tags.seq_identity(F.lit(cigar), F.lit(t), F.lit("A" * 100)))
    assert f("10S80M2I8M", "NM:i:3") == 87 and f("*", "") == 0 and f("100M", "") == 100


def test_valid_reads(spark):
    ok = lambda s: one(spark, sequence.is_valid_read(F.lit(s)))
    assert ok("") and ok("acgt" * 25) and ok("ACGT" * 25 + "NN") and not ok("ACGT" * 24 + "NNN") and not ok("ACGX")


@settings(max_examples=20, deadline=None)
@given(hs.text("ACGTNRYacgt", max_size=30))
def test_reverse_complement_twice_is_the_sequence(spark, text):
    assert one(spark, sequence.reverse_complement(sequence.reverse_complement(F.lit(text)))) == text


def test_canonical_kmer_is_the_same_for_both_strands(spark):
    for s in ("ACGTT", "TTTTT", "GATTACA"):
        both = [one(spark, sequence.canonical_kmer(c)) for c in (F.lit(s), sequence.reverse_complement(F.lit(s)))]
        assert both[0] == both[1] and both[0] is not None
    assert one(spark, sequence.canonical_kmer(F.lit("ACN"))) is None
    assert one(spark, sequence.kmers(F.lit("AC"), 3)) == []


def test_ambiguity(spark):
    assert one(spark, sequence.ambiguity_and(F.lit("R"), F.lit("M"))) == "A"
    assert one(spark, sequence.ambiguity_or(F.lit("A"), F.lit("G"))) == "R"
    assert one(spark, sequence.ambiguity_is_subset(F.lit("A"), F.lit("N"))) is True
    assert one(spark, sequence.nucleotides_to_colours(F.lit("ACGT N"))) == "131.N"


def test_ambiguity_of_all_letters_in_both_cases(spark):
    """Sets of bases, with the case rules stated anew."""
    bases = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
    letter = {frozenset(v): k for k, v in bases.items()} | {frozenset(): "N"}
    letters = [x for k in bases for x in (k, k.lower())]
    rows = spark.createDataFrame([(a, b) for a in letters for b in letters], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in rows.select("a", "b", sequence.ambiguity_and(a, b).alias("both"), sequence.ambiguity_or(a, b).alias("any"), sequence.ambiguity_is_subset(a, b).alias("part")).collect():
        x, y = (set(bases[v.upper()]) for v in (r.a, r.b))
        low = [v.islower() for v in (r.a, r.b)]
        both, either = letter[frozenset(x & y)], letter[frozenset(x | y)]
        both = both.lower() if all(low) else both
        assert (r.both, r.any, r.part) == (both, either.lower() if any(low) else either, both in (r.a, r.b))


def test_colours(spark):
    for text, colours in (("ACGT", "131"), ("aNcN", "nnn"), ("TN", "N"), ("A", ""), ("", ""), ("GGGA", "002"), ("AC-T", "1..")):
        assert one(spark, sequence.nucleotides_to_colours(F.lit(text))) == colours
    back = lambda a, c: one(spark, sequence.colours_to_nucleotides(F.lit(a), F.lit(c)))
    assert back("A", "131") == "ACGT" and back("t", "") == "t" and back("C", "0.01") == "CCNNN" and back("N", "01") == "NNN"


@settings(max_examples=20, deadline=None)
@given(hs.text("ACGT", min_size=1, max_size=40))
def test_colours_and_back(spark, text):
    assert one(spark, sequence.colours_to_nucleotides(F.lit(text[0]), sequence.nucleotides_to_colours(F.lit(text)))) == text


def test_short_numbers(spark):
    numbers = [0.0, 5.0, 999.0, 999.9, 1000.0, 1234.0, 12350.0, 123456.0, 122500.0, 123500.0, 1e6, 9.995e8, 1.5e9, 1e12, 2.5e15, -5000.0, 0.00001234, 1.015]
    rows = spark.createDataFrame([(x,) for x in [*numbers, None]], "x double").select("x", formatting.to_si(F.col("x")).alias("si"), formatting.to_eng(F.col("x")).alias("eng"))
    got = {r.x: (r.si, r.eng) for r in rows.collect()}
    si = ["0 ", "5 ", "999 ", "1e+03 ", "1 k", "1.23 k", "12.3 k", "123 k", "122 k", "124 k", "1 M", "1e+03 M", "1.5 G", "1 T", "2.5e+03 T", "-5e+03 ", "1.23e-05 ", "1.01 "]
    eng = ["0", "5", "999", "999.9", "1000", "1234", "12350", "123456", "122500", "123500", "1000000", "999.5e6", "1.5e9", "1e12", "2500e12", "-5000", "1.234e-05", "1.015"]
    assert [got[x] for x in numbers] == list(zip(si, eng, strict=True)) and got[None] == (None, None)


def test_params():
    p = ScaffoldParams.from_args(["--kmers", "-f", "x.fa", "-m", "8-100", "-k", "40", "-t", "4", "--gap=50", "r.fq"])
    assert (p.kmer_mode, p.min_mult, p.max_mult, p.k_value, p.gap, p.inputs) == (True, 8, 100, 40, 50, ("r.fq",))
    assert p.named().tsv_name.endswith("_main.tsv")
    for bad in (["-k", "30", "a.sam"], ["--kmers", "-f", "x", "-s", "90"], ["--kmers"], ["--what"]):
        with pytest.raises(ValueError):
            ScaffoldParams.from_args(bad)
