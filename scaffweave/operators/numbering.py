"""Gapless numbers in a global order without a global sort in one task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is set, one in the warehouse, which its tasks share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run in here give their shuffle files back once they have run; those that lie in files by then need them no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(frame: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder; what was shuffled for it is freed."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with shuffles_freed(spark):
        return frame.select("*").checkpoint()


def number_rows(frame: DataFrame, order: list[str], name: str = "idx", start: int = 0) -> DataFrame:
    """frame with `name`: 0, 1, 2, ... in the order of the columns.

    Rows are dealt by ranges of the order and sorted within each range, which numbers them, and shifted by the counts of
    the ranges before; only those counts (a small row a range) meet in one task and are sent to all. Rows move once.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(frame.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    # a place counts the rows of its range, which begins at the first of them
    counts = ranged.groupBy(F.shiftright("__place", 33).alias("__range")).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    numbered = ranged.join(F.broadcast(begins), F.shiftright("__place", 33) == F.col("__range"))
    return numbered.withColumn(name, (F.col("__place") + F.col("__shift") + start).cast("long")).drop("__range", "__place", "__shift")


def sums_before(frame: DataFrame, value: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """frame with `name`: the sum of `value` over the rows before, in the order of the columns, for each `by`.

    Rows are dealt by ranges of the order and summed within each range; each range begins with the sum of the ranges
    before, so no value of `by` is one task.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(frame.withColumn("__value", value).repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__value").alias("__sum"))
    begins = totals.withColumn("__begin", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    within = F.sum("__value").over(Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("__within", F.coalesce(within, F.lit(0))).join(begins, [*by, "__range"])
    return placed.withColumn(name, F.col("__begin") + F.col("__within")).drop("__value", "__range", "__within", "__begin")


def last_up_to(frame: DataFrame, values: dict[str, Column], by: list[str], order: list[str]) -> DataFrame:
    """frame with a column for each of `values`: its last value that is not null in this row or one before, in the order
    of the columns (which differ from row to row), for each `by`.

    Rows are dealt by ranges of the order; each range begins with the last values of the ranges before.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {f"__own_{i}": v for i, v in enumerate(values.values())}
    ranged = saved(frame.withColumns(own).repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()))
    lasts = ranged.groupBy(*by, "__range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__last{c}") for c in own])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = lasts.select(*by, "__range", *[F.last(f"__last{c}", ignorenulls=True).over(earlier).alias(f"__begin{c}") for c in own])
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({f"__within{c}": F.last(c, ignorenulls=True).over(within) for c in own}).join(begins, [*by, "__range"])
    return placed.select(*frame.columns, *[F.coalesce(f"__within{c}", f"__begin{c}").alias(name) for c, name in zip(own, values, strict=True)])
