"""Column functions over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC letters, and their complements in the same order.
IUPAC = "ACGTNMRWSYKVHDB"
COMPLEMENT = "TGCANKYWSRMBDHV"
# The bases that each IUPAC letter stands for, as bits of A=1 C=2 G=4 T=8.
MASKS = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}


def reverse_complement(seq: Column) -> Column:
    """The other strand, read in its own direction; keeps case and knows all IUPAC letters."""
    return F.reverse(F.translate(seq, IUPAC + IUPAC.lower(), COMPLEMENT + COMPLEMENT.lower()))


def canonical_kmer(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, in capitals; null if it holds other than ACGT."""
    up = F.upper(kmer)
    return F.when(up.rlike("^[ACGT]+$"), F.least(up, F.reverse(F.translate(up, "ACGT", "TGCA"))))


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """All windows of length k as an array; empty if the sequence is shorter."""
    last = F.length(seq) - k + 1
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step))
    return F.when(last >= 1, F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def is_valid_contig(seq: Column) -> Column:
    return seq.rlike(f"(?i)^[{IUPAC}]*$")


def is_valid_read(seq: Column, most_n: float = 0.02) -> Column:
    """Only A, C, G, T and N, and of N no more than the share; an empty read is valid."""
    n = F.length(seq) - F.length(F.replace(F.upper(seq), F.lit("N"), F.lit("")))
    return seq.rlike("(?i)^[ACGTN]*$") & (n <= F.length(seq) * most_n)


def kmer_fraction(found: Column, total: Column) -> Column:
    return found / F.nullif(total.cast("double"), F.lit(0.0))


def ambiguity_mask(letter: Column) -> Column:
    """The bases an IUPAC letter stands for, as bits, of a colour 0 to 3 its own bit; null for other letters."""
    table = F.create_map(*[F.lit(x) for pair in (MASKS | {str(i): 1 << i for i in range(4)}).items() for x in pair])
    return F.try_element_at(table, F.upper(letter))


def mask_letter(mask: Column) -> Column:
    """The letter of a set of bases; N for none."""
    table = F.create_map(*[F.lit(x) for a, b in [*MASKS.items(), ("N", 0)] for x in (b, a)])
    return F.try_element_at(table, mask)


def _is_lower(letter: Column) -> Column:
    return letter != F.upper(letter)


def ambiguity_and(a: Column, b: Column) -> Column:
    """The letter of the bases that both stand for (N for none), lower-case if both letters are."""
    out = mask_letter(ambiguity_mask(a).bitwiseAND(ambiguity_mask(b)))
    return F.when(_is_lower(a) & _is_lower(b), F.lower(out)).otherwise(out)


def ambiguity_or(a: Column, b: Column) -> Column:
    """The letter of the bases that one of them stands for, lower-case if one of the letters is."""
    out = mask_letter(ambiguity_mask(a).bitwiseOR(ambiguity_mask(b)))
    return F.when(_is_lower(a) | _is_lower(b), F.lower(out)).otherwise(out)


def ambiguity_is_subset(a: Column, b: Column) -> Column:
    """Whether one of the letters, either of them, is the letter of the bases that they share, in its own case."""
    both = ambiguity_and(a, b)
    return (both == a) | (both == b)


def nucleotides_to_colours(seq: Column) -> Column:
    """Colours of neighbouring bases: the exclusive or of their two-bit codes; N beside N (n, if one of the two is
    lower-case), '.' beside other letters."""
    letters = F.split(seq, "")
    rest = F.greatest(F.size(letters) - 1, F.lit(0))
    code = lambda c: F.instr(F.lit("ACGT"), F.upper(c)) - 1

    def colour(x: Column, y: Column) -> Column:
        unknown = F.when(_is_lower(x) | _is_lower(y), F.lit("n")).otherwise(F.lit("N"))
        known = F.when((code(x) < 0) | (code(y) < 0), F.lit(".")).otherwise(code(x).bitwiseXOR(code(y)).cast("string"))
        return F.when((F.upper(x) == "N") | (F.upper(y) == "N"), unknown).otherwise(known)

    return F.array_join(F.zip_with(F.slice(letters, F.lit(1), rest), F.slice(letters, F.lit(2), rest), colour), "")


def colours_to_nucleotides(anchor: Column, colours: Column) -> Column:
    """The bases that begin with the anchor and step by the colours 0 to 3: a running exclusive or of two-bit codes.

    From the first colour on that is none of these all further bases are N; so they are for an anchor that is no
    base. The anchor is kept as it is; null gives null.
    """
    codes = F.transform(F.filter(F.split(colours, ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123"), c) - 1)
    start = F.instr(F.lit("ACGT"), F.upper(anchor)) - 1
    state = F.struct(start.cast("int").alias("code"), anchor.alias("text"))

    def step(s: Column, c: Column) -> Column:
        now = F.when((s["code"] < 0) | (c < 0), F.lit(-1)).otherwise(s["code"].bitwiseXOR(c)).cast("int")
        letter = F.when(now < 0, F.lit("N")).otherwise(F.substring(F.lit("ACGT"), now + 1, F.lit(1)))
        return F.struct(now.alias("code"), F.concat(s["text"], letter).alias("text"))

    return F.aggregate(codes, state, step, lambda s: s["text"])


def sense_sign(orientation: Column, first: bool) -> Column:
    """'-' or '+' of the first or second contig of a pair by its orientation (HH 0, HT 1, TH 2, TT 3)."""
    return F.when((orientation < 2) if first else (orientation % 2 == 1), F.lit("-")).otherwise(F.lit("+"))
