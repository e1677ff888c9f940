"""Reads of FASTA, FASTQ, alignment, qseq and export files alike, filtered and trimmed by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .records import read_line_records
from .sequences import READS, read_records

#: Ends of the names of files with one read a line and tabs between its fields.
TABBED = (".sam", ".qseq", "qseq.txt", ".export", "export.txt")
_OUT = ["file", "ord", "name", "comment", "anchor", "seq", "qual", "offset", "chaste"]


def _fail(when: Column, value: Column, text: str, what: Column) -> Column:
    """value, or an error where the condition holds."""
    return F.when(when, F.raise_error(F.concat(F.lit(text), F.coalesce(what, F.lit(""))))).otherwise(value)


def _same_size(seq: Column, qual: Column, name: Column) -> Column:
    return _fail(F.length(qual) != F.length(seq), qual, "sequence and quality differ in length: ", name)


def _fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, ord, name, comment, seq, qual) of FASTA; lines that begin with # are left out."""
    rows = read_records(spark, paths, "\n>").withColumn("line", F.regexp_replace("line", r"\r|(?m)^#.*\n?", ""))
    rows = rows.withColumn("line", F.regexp_replace("line", r"\A>", "")).filter("trim(line) <> ''")
    head, body = F.substring_index("line", "\n", 1), F.regexp_extract("line", r"(?s)\A[^\n]*\n?(.*)", 1)
    return rows.select(
        "file", "ord", F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\s*\S+\s+(.*)$", 1).alias("comment"),
        F.regexp_replace(body, r"\n", "").alias("seq"), F.lit(None).cast("string").alias("qual"),
    )


def _anchored(rows: DataFrame) -> DataFrame:
    """Reads in colours lose their first base and first colour; the base that these make together is the anchor."""
    first, second = F.upper(F.substring("seq", 1, 1)), F.substring("seq", 2, 1)
    coloured = F.regexp_extract("seq", r"(?s)^.[^ACGTacgt0-3]*([ACGTacgt0-3])", 1).rlike("[0-3]")
    led = coloured & ~F.substring("seq", 1, 1).rlike("[0-9]")
    code = (F.instr(F.lit("ACGT"), first) - 1).bitwiseXOR(F.instr(F.lit("0123"), second) - 1)
    base = F.when(second == ".", F.lit("N")).otherwise(F.substring(F.lit("ACGT"), code + 1, F.lit(1)))
    rows = rows.withColumns({"__coloured": coloured, "anchor": F.when(led, base)})
    size = F.length("seq")
    # the quality may begin with the primer's or with the first colour's
    skipped = F.when(F.length("qual") == size, 3).otherwise(2)
    seq = F.when(F.col("anchor").isNotNull(), F.substring(F.col("seq"), F.lit(3), size)).otherwise(F.col("seq"))
    qual = F.when(F.col("anchor").isNotNull(), F.substring(F.col("qual"), skipped, size)).otherwise(F.col("qual"))
    return rows.withColumns({"seq": seq, "qual": qual})


def _records(rows: DataFrame, min_length: int, trim_masked: bool, fold_case: bool) -> DataFrame:
    name, comment = F.col("name"), F.coalesce("comment", F.lit(""))
    header = name.rlike("^[A-Z]{2}$") & (F.substring(comment, 3, 1) == ":")
    rows = rows.withColumn("comment", comment).filter(~(header | (name == "CO")))
    casava = F.col("comment").rlike("(?s)^.:.:")
    numbered = F.when(casava & (F.length(name) > 2) & (F.substring(name, -2, 1) != "/"), F.concat(name, F.lit("/"), F.substring("comment", 1, 1))).otherwise(name)
    rows = rows.withColumns({"chaste": ~(casava & (F.substring("comment", 3, 1) == "Y")), "name": numbered})
    # an unchaste read is passed over before its sequence is looked at
    empty = F.col("chaste") & (F.coalesce("seq", F.lit("")) == "")
    rows = rows.withColumn("seq", _fail(empty, F.col("seq"), "an empty sequence: ", F.col("name"))).filter(F.length("seq") >= min_length)
    rows = _anchored(rows)
    rows = rows.withColumn("qual", _same_size(F.col("seq"), F.nullif("qual", F.lit("")), F.col("name")))
    if trim_masked:
        bare = F.regexp_replace("seq", "[a-z]+$", "")
        front = F.length(F.regexp_extract(bare, "^([a-z]*)", 1))
        kept = lambda c: F.when(F.col("__coloured"), F.col(c)).otherwise(F.substring(F.col(c), front + 1, F.length(bare) - front))
        rows = rows.withColumns({"seq": kept("seq"), "qual": kept("qual")})
    if fold_case:
        rows = rows.withColumn("seq", F.upper("seq"))
    return rows.withColumn("offset", F.lit(33)).select(*_OUT)


def _tabbed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One read a line: alignments (11 fields or more, bases and qualities of one size), qseq (11) or export (22)."""
    lines = read_records(spark, paths).withColumn("line", F.regexp_replace("line", "\r$", "")).filter("line <> '' and not line rlike '^[@#]'")
    p = lines.withColumn("p", F.split("line", "\t"))
    at = lambda i: F.try_element_at("p", F.lit(i + 1))
    n = F.size("p")
    aligned = (n >= 11) & ((F.length(at(9)) == F.length(at(10))) | (at(10) == "*"))
    form = F.when(aligned, F.lit("alignment")).when(n.isin(11, 22), F.lit("qseq"))
    p = p.select("file", "ord", "p", "line", _fail(form.isNull(), form, "neither a record nor 11 fields: ", F.col("line")).alias("form"))

    flag = at(1).try_cast("int")
    bit = lambda b: flag.bitwiseAND(b) != 0
    sides = flag.bitwiseAND(0xC1)
    side = F.when(sides.isin(0, 1), F.lit("0")).when(sides == 0x41, F.lit("1")).when(sides == 0x81, F.lit("2"))
    side = _fail(side.isNull(), side, "flags that make no sense: ", F.col("line"))
    turned = lambda text, other: F.when(bit(0x10), other(text)).otherwise(text)
    seq, qual = F.when(at(9) == "*", "").otherwise(at(9)), F.when(at(10) != "*", at(10))
    alignments = p.filter("form = 'alignment'").filter(~bit(0x100)).withColumn("side", side).select(
        "file", "ord", F.concat(at(0), F.when(F.col("side") == "0", F.lit("")).otherwise(F.concat(F.lit("/"), "side"))).alias("name"),
        F.concat("side", F.when(bit(0x200), F.lit(":Y:0:")).otherwise(F.lit(":N:0:"))).alias("comment"), F.lit(None).cast("string").alias("anchor"),
        turned(seq, reverse_complement).alias("seq"), _same_size(seq, turned(qual, F.reverse), at(0)).alias("qual"), F.lit(33).alias("offset"), (~bit(0x200)).alias("chaste"),
    )

    last = F.element_at("p", -1)
    chaste = F.when(last.isin("1", "Y"), True).when(last.isin("0", "N"), False)
    chaste = _fail(chaste.isNull(), chaste, "chastity is none of 0, 1, N and Y: ", F.col("line"))
    place = F.array_join(F.concat(F.array(at(0)), F.filter(F.slice("p", 2, 5), lambda x: x != "")), ":")
    index = F.when(~at(6).isin("", "0"), F.concat(F.lit("#"), at(6))).otherwise("")
    number = F.when(at(7) == "3", F.lit("2")).otherwise(at(7))
    others = p.filter("form = 'qseq'").withColumn("chaste", chaste).select(
        "file", "ord", F.concat(place, index, F.lit("/"), number).alias("name"), F.concat(at(7), F.when(F.col("chaste"), F.lit(":N:0:")).otherwise(F.lit(":Y:0:"))).alias("comment"),
        F.lit(None).cast("string").alias("anchor"), at(8).alias("seq"), _same_size(at(8), at(9), F.col("line")).alias("qual"), F.lit(64).alias("offset"), "chaste",
    )
    return alignments.select(*_OUT).unionByName(others.select(*_OUT))


def _good_part(rows: DataFrame, threshold: int) -> DataFrame:
    """From the first to the last letter whose quality reaches the threshold; the first letter, if none does."""
    codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c) >= F.col("offset") + threshold)
    first = F.array_position(codes, F.lit(True))
    last = F.size(codes) + 1 - F.array_position(F.reverse(codes), F.lit(True))
    low = F.when(first > 0, first).otherwise(F.lit(1)).cast("int")
    size = F.when(first > 0, last - first + 1).otherwise(F.lit(1)).cast("int")
    has = F.coalesce(F.length("qual"), F.lit(0)) > 0
    part = lambda c: F.when(has, F.substring(F.col(c), F.col("__low"), F.col("__size"))).otherwise(F.col(c))
    return rows.withColumns({"__low": low, "__size": size}).withColumns({"seq": part("seq"), "qual": part("qual")}).drop("__low", "__size")


def read_rich(
    spark: SparkSession, *paths: str, chastity: bool = True, min_length: int = 0, trim_masked: bool = False, fold_case: bool = True,
    max_length: int = 0, quality: int = 0, quality_offset: int = 0, convert_quality: bool = False,
) -> DataFrame:
    """(file, ord, name, comment, anchor, seq, qual) of reads, one way for every format.

    Files are told by the ends of their names: FASTQ, one read a line with tabs (there each line tells whether it is an
    alignment, qseq or export), and all others FASTA. Headers of alignment text and secondary alignments are no reads. A
    read on the reverse strand is turned back. Names get `/1` or `/2` from flags or from comments like `1:N:0:`.

    chastity: reads that the machine rejected go. min_length: shorter ones of FASTA and FASTQ go. trim_masked: lower-case ends
    of these are cut, fold_case: their letters become capitals. max_length: longer reads are cut at their end. quality:
    reads are cut to what lies between their first and last letter of that quality, and to one letter if none has
    it. Qualities count from 33, in qseq and export from 64, or from quality_offset; convert_quality writes them from 33.
    anchor is the base before reads in colours; in FASTQ their primer has a quality too. A FASTA or FASTQ read with no letters raises, and so do qualities of
    another size, chastity or flags that make no sense, and qualities under -5 or over 41 that are to be converted.
    """
    fastq = [p for p in paths if p.endswith(READS)]
    tabbed = [p for p in paths if p.endswith(TABBED)]
    fasta = [p for p in paths if p not in fastq and p not in tabbed]
    parts = []
    if fasta:
        parts.append(_records(_fasta(spark, fasta), min_length, trim_masked, fold_case))
    if fastq:
        parts.append(_records(read_line_records(spark, fastq), min_length, trim_masked, fold_case))
    if tabbed:
        parts.append(_tabbed(spark, tabbed))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if chastity:
        rows = rows.filter("chaste")
    if quality_offset:
        rows = rows.withColumn("offset", F.lit(quality_offset))
    if max_length:
        rows = rows.withColumns({c: F.substring(c, 1, max_length) for c in ("seq", "qual")})
    if quality:
        rows = _good_part(rows, quality)
    if convert_quality:
        rows = rows.withColumn("qual", _from_33(F.col("qual"), F.col("offset")))
    return rows.drop("offset", "chaste")


def _from_33(qual: Column, offset: Column) -> Column:
    """Qualities counted from 33; those below 0 become 0."""
    scores = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)
    wrong = F.exists(scores, lambda x: (x < -5) | (x > 41))
    text = F.array_join(F.transform(scores, lambda x: F.char(F.greatest(x, F.lit(0)) + 33)), "")
    return F.when((offset == 33) | (F.length(qual) == 0), qual).otherwise(_fail(wrong, text, "a quality out of range: ", qual))
