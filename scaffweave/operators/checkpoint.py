"""Contig pair rows for a downstream scaffolder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_rows(edges: DataFrame, numbers: DataFrame, distance: str | None = None) -> DataFrame:
    """(category, node_a, node_b, links, gap): a forward and a reverse row for each edge.

    numbers has (contig, number). A node is f or r and the contig's number; the gap is links times the
    distance, 100 where none is estimated (category 10; otherwise by the distance's size).
    """
    given = F.col(distance) if distance else F.lit(None).cast("int")
    d = F.coalesce(given, F.lit(100))
    category = F.when(given.isNull(), 10)
    category = F.when(d < 0, -1).otherwise(category)
    for bound in (5000, 1000, 500):
        category = F.when((given >= 0) & (given < bound), bound).otherwise(category)
    category = F.when(given >= 5000, 10000).otherwise(category)
    number = lambda c, name: numbers.select(F.col("contig").alias(c), F.col("number").alias(name))
    rows = edges.join(number("u", "__a"), "u").join(number("v", "__b"), "v")
    a_sign = F.when(F.col("orientation") < 2, "r").otherwise("f")
    b_sign = F.when(F.col("orientation") % 2 == 0, "f").otherwise("r")
    flip = lambda c: F.translate(c, "fr", "rf")
    a, b = F.col("__a").cast("string"), F.col("__b").cast("string")
    one = F.struct(F.concat(a_sign, a).alias("node_a"), F.concat(b_sign, b).alias("node_b"))
    two = F.struct(F.concat(flip(b_sign), b).alias("node_a"), F.concat(flip(a_sign), a).alias("node_b"))
    out = rows.select(category.cast("int").alias("category"), F.explode(F.array(one, two)).alias("r"), F.col("weight").alias("links"), (F.col("weight") * d).cast("long").alias("gap"))
    return out.select("category", "r.node_a", "r.node_b", "links", "gap")
