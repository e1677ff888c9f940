"""Graph files of the DOT language with defaults that hold from where they stand, and lists of estimates by contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import better_estimates
from ..operators.numbering import last_up_to
from .sequences import read_records

_ID = r'(?:"[^"]*"|[\w.+-]+)'
_SET = r"\[[^\]]*\]"
#: One statement: the opening of the graph, an edge to one vertex or to several in braces, settings, or a vertex.
_STATEMENT = rf"(?:di)?graph\b[^\[{{;]*\{{|{_ID}\s*(?:->|--)\s*(?:\{{[^}}]*\}}|{_ID})(?:\s*{_SET})?|{_ID}(?:\s*{_SET})?"
_EDGE_TYPE = "struct<d: int, e: double, n: long>"


def number_of(name: str, text: Column) -> Column:
    """The value of an attribute in square brackets, quoted or not, as text; null if it is not there."""
    return F.nullif(F.regexp_extract(text, rf'[\[,\s]{name}\s*=\s*"?([-+.\w]+)', 1), F.lit(""))


def _names(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({_ID})"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, '"', ""))


def statements(lines: DataFrame) -> DataFrame:
    """(file, ord, at, text) of lines (file, ord, line): the statements of each line. A statement lies within one line;
    text that belongs to no statement raises."""
    rest = F.regexp_replace(F.regexp_replace("line", _STATEMENT, ""), r"[\s;}]", "")
    line = F.when(rest == "", F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no statement: "), F.col("line"))))
    found = lines.filter("trim(line) <> ''").select("file", "ord", F.regexp_extract_all(line, F.lit(f"({_STATEMENT})"), F.lit(1)).alias("all"))
    return found.select("file", "ord", F.posexplode("all").alias("at", "text"))


def read_dot(spark: SparkSession, *paths: str, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (file, id, length, coverage) and edges (file, src, dst, d, e, n) of graph files.

    `edge [d=.. e=.. n=..]` holds for the later edges of its file that have no d of their own, and for all edges to
    several vertices in braces, until the next one. Where none stands before, d is 1 - k, of `graph [k=..]` before it or
    else of the parameter, and null without either. An edge with d alone has e and n 0. Parallel edges become one: the
    least error, then the largest d, all pairs together. `a -- b` is `b -- a`.

    Defaults are carried over ranges of the file's lines, one row a range, so no file is one task.
    """
    rows = statements(read_records(spark, list(paths)))
    text = F.col("text")
    head = F.regexp_replace(text, r"\[.*$", "")
    arrow = F.regexp_extract(text, rf"^{_ID}\s*(->|--)", 1)
    rows = rows.select("*", head.alias("head"), arrow.alias("arrow"), F.regexp_extract(text, r"(\[.*)$", 1).alias("set"))
    own = F.when(number_of("d", F.col("set")).isNotNull(), F.struct(
        number_of("d", F.col("set")).cast("int").alias("d"), F.coalesce(number_of("e", F.col("set")).cast("double"), F.lit(0.0)).alias("e"),
        F.coalesce(number_of("n", F.col("set")).cast("long"), F.lit(0)).alias("n"),
    ).cast(_EDGE_TYPE))
    word = F.trim("head")
    opening = text.rlike(r"^(?:di)?graph\b[^\[]*\{$")
    setting = F.when(word == "edge", F.lit("default")).otherwise(word)
    kind = F.when(F.col("arrow") != "", F.lit("edge")).when(opening, F.lit("open")).when((F.col("set") != "") & word.isin("graph", "node", "edge"), setting).otherwise("vertex")
    rows = rows.select("file", "ord", "at", "head", "set", "arrow", kind.alias("kind"), own.alias("own"))
    names = _names(F.regexp_replace("head", r"->|--", " "))
    vertices = rows.filter("kind = 'vertex'").select(
        "file", names[0].alias("id"), number_of("l", F.col("set")).cast("long").alias("length"), number_of("C", F.col("set")).cast("long").alias("coverage")
    ).distinct()

    several = F.col("head").rlike(r"\{")
    ends = rows.filter("kind = 'edge'").select("file", "ord", "at", "arrow", names.alias("names"), F.when(~several, F.col("own")).alias("own"))
    settled = ends.filter("own is not null").withColumn("edge", F.col("own"))
    first_k = F.when(F.col("kind") == "graph", number_of("k", F.col("set")).cast("int"))
    settings = rows.filter("kind in ('graph', 'default')").select("file", "ord", "at", F.when(F.col("kind") == "default", F.col("own")).alias("own"), first_k.alias("k"))
    open_ends = ends.filter("own is null").select("file", "ord", "at", "arrow", "names").unionByName(settings, allowMissingColumns=True)
    carried = last_up_to(open_ends, {"default": F.col("own"), "k_before": F.col("k")}, ["file"], ["ord", "at"]).filter("names is not null")
    plain = F.struct((1 - F.coalesce("k_before", F.lit(k).cast("int"))).alias("d"), F.lit(0.0).alias("e"), F.lit(0).cast("long").alias("n")).cast(_EDGE_TYPE)
    both = settled.select("file", "arrow", "names", "edge").unionByName(carried.select("file", "arrow", "names", F.coalesce("default", plain).alias("edge")))
    edges = both.select("file", "arrow", F.col("names")[0].alias("src"), F.explode(F.slice("names", 2, F.size("names"))).alias("dst"), "edge.*")
    turned = (F.col("arrow") == "--") & (F.col("src") > F.col("dst"))
    edges = edges.select("file", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), "d", "e", "n")
    return vertices, better_estimates(edges, ["file", "src", "dst"])


def read_estimates(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, ord, contig_id, reverse, place, target, target_strand, d, n, e) of `contig a+,d,n,e b-,d,n,e ; c+,d,n,e`.

    The estimates before the semicolon go out of the contig, those after it out of its reverse complement (`reverse`); a
    contig without any has no rows. An entry that is no estimate raises.
    """
    lines = read_records(spark, list(paths)).filter("trim(line) <> ''")
    name = F.regexp_extract("line", r"^\s*([^\s;]+)", 1)
    sides = F.split(F.regexp_replace("line", r"^\s*[^\s;]+", ""), ";", 2)
    rows = lines.select("file", "ord", name.alias("contig_id"), F.posexplode(sides).alias("side", "list"))
    entries = F.regexp_extract_all("list", F.lit(r"(\S+)"), F.lit(1))
    rows = rows.select("file", "ord", "contig_id", (F.col("side") == 1).alias("reverse"), F.posexplode(entries).alias("place", "entry"))
    form = r"^(.+)([+-]),(-?\d+),(\d+),(\d+\.?\d*)$"
    entry = F.when(F.col("entry").rlike(form), F.col("entry")).otherwise(F.raise_error(F.concat(F.lit("no estimate: "), F.col("entry"))))
    part = lambda i: F.regexp_extract("entry", form, i)
    rows = rows.withColumn("entry", entry)
    return rows.select(
        "file", "ord", "contig_id", "reverse", "place", part(1).alias("target"), part(2).alias("target_strand"),
        part(3).cast("int").alias("d"), part(4).cast("long").alias("n"), part(5).cast("double").alias("e"),
    )


def estimate_lines(rows: DataFrame) -> DataFrame:
    """(contig_id, value): rows (contig_id, reverse, place, target, target_strand, d, n, e) as a line for each contig."""
    entry = F.concat_ws(",", F.concat("target", "target_strand"), F.col("d"), F.col("n"), F.format_string("%.1f", F.col("e").cast("double")))
    lists = rows.groupBy("contig_id").agg(*[F.sort_array(F.collect_list(F.when(side, F.struct("place", entry.alias("entry"))))).alias(n) for n, side in (("ahead", ~F.col("reverse")), ("back", F.col("reverse")))])
    text = lambda n: F.transform(n, lambda x: x["entry"])
    return lists.select("contig_id", F.array_join(F.concat(F.array("contig_id"), text("ahead"), F.array(F.lit(";")), text("back")), " ").alias("value"))
