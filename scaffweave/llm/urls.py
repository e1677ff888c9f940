"""URL rules behind a blocked Bloom filter. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict) of the fixed rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The most 64-bit blocks that a filter gets: 1 MB. A longer list raises the false positives, not the size.
MAX_BLOCKS = 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    plain = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), entry), F.lit(blocks)).cast("int")


def _bits(entry: Column, probes: int = 6) -> Column:
    """The bits of an entry within its block: one 64-bit word, so a test touches one place."""
    h = F.xxhash64(F.lit("bits"), entry)
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(probes)]
    return reduce(lambda x, y: x.bitwiseOR(y), one)


def bloom_filter(listed: DataFrame, entry: str, bits_per_entry: int = 16) -> list[int]:
    """The filter's words. Their number is a power of two, MAX_BLOCKS at most, so they fit in the plan."""
    n = max(1, listed.count())
    blocks = min(MAX_BLOCKS, 1 << max(0, (n * bits_per_entry - 1) // 64).bit_length())
    words = (
        listed.filter(F.col(entry).isNotNull())
        .groupBy(_block(F.col(entry), blocks).alias("block"))
        .agg(F.bit_or(_bits(F.col(entry))).alias("word"))
        .collect()
    )
    out = [0] * blocks
    for row in words:
        out[row["block"]] = row["word"]
    return out


def may_hold(words: list[int], entry: Column) -> Column:
    """False only for entries that are surely not in the filter."""
    mask = _bits(entry)
    held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")  # a constant that Spark folds
    word = F.element_at(held, _block(entry, len(words)) + 1)
    return word.bitwiseAND(mask) == mask


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict.

    A listed entry is a rule's host and path in one string. A url's candidates are the last labels of its
    host (as many as any rule has) with the starts of its path (as long as any rule's); the blocked Bloom
    filter of the list drops most, an exact join the false positives, and the longest entry left decides
    (of rules listed twice with the same length, the larger string and then verdict). No entry: `default`.
    Rules of (host, path, verdict) hosts are lower-case. Null urls and those without :// have empty host
    and path and get the default; repeated pages each get a row; an empty rule list or table is fine.
    """
    listed = rules.select(F.concat("host", "path").alias("entry"), "host", "path", "verdict").filter("entry is not null").distinct()
    shape = listed.agg(F.max(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    labels, lengths = shape[0] or 0, sorted(shape[1])
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    tries = [
        F.when(F.length("path") >= n, F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k in range(1, labels + 1) for n in lengths
    ]
    if tries:
        words = bloom_filter(listed, "entry")
        hits = F.array_distinct(F.filter(F.array(*tries), lambda x: x.isNotNull() & (x != "") & may_hold(words, x)))
        found = (
            urls.select("url", F.explode(hits).alias("entry"))
            .join(listed.select("entry", F.col("verdict").alias("said")), "entry")
            .groupBy("url")
            .agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "said")).alias("best"))
        )
        judged = urls.join(found, "url", "left")
    else:
        judged = urls.withColumn("best", F.lit(None).cast("struct<n:int,entry:string,said:string>"))
    verdicts = judged.select("url", "host", "path", F.col("best.entry").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))
    rows = pages.select(F.col(key), F.col(url).alias("page_url"))
    return rows.join(verdicts, F.col("page_url").eqNullSafe(F.col("url"))).select(key, "host", "path", "rule", "verdict")
