"""Result files that are one ordered file, written by all tasks at once."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .numbering import saved, shuffles_freed


@dataclass
class _Wrote(WriterCommitMessage):
    size: int
    ranges: list[tuple[int, int]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Writes lines (number, begin, value) to a file beside the target; the commit gives it the target's name.

    A range of lines, numbered one after another, begins at a place of the file and lies there in one piece. A line is always written at the same place, so tasks that run twice do no harm.
    """

    def __init__(self, options: dict):
        self.path = os.path.abspath(options["path"].removeprefix("file:"))
        self.part = f"{self.path}.{options['run']}.part"
        self.size = int(options["size"])
        os.makedirs(os.path.dirname(self.path), exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        sizes, file = {}, os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        begin, after, place = -1, 0, 0
        try:
            for batch in iterator:
                number, begins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                lines = [x.encode() + b"\n" for x in batch.column(2).to_pylist()]
                cuts = [0, *(np.flatnonzero(begins[1:] != begins[:-1]) + 1).tolist(), len(lines)]
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    if low < high:
                        if begins[low] != begin:
                            begin = place = int(begins[low])
                            after = int(number[low])
                        if (number[low:high] != np.arange(after, after + high - low)).any():
                            raise OSError("lines do not come in their order")
                        after += high - low
                        data = memoryview(b"".join(lines[low:high]))
                        sizes[begin] = sizes.get(begin, 0) + len(data)
                        while data:  # a call may write a part only
                            done = os.pwrite(file, data, place)
                            data, place = data[done:], place + done
            os.fsync(file)
        finally:
            os.close(file)
        return _Wrote(sum(sizes.values()), list(sizes.items()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        wrote = sum(m.size for m in messages if m is not None)
        ranges = sorted(x for m in messages if m is not None for x in m.ranges)
        gapless = all(begin + size == after for (begin, size), after in zip(ranges, [*(x for x, _ in ranges[1:]), self.size], strict=False))
        with open(self.part, "ab"):  # there is none if there are no lines
            pass
        if wrote != self.size or not gapless or os.path.getsize(self.part) != self.size:
            self.abort(messages)
            raise OSError(f"{wrote} of {self.size} bytes of {self.path} were written; its folder must be one that all tasks share")
        os.replace(self.part, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class OneFile(DataSource):
    """df.write.format("one_file"): columns (number, begin, value), see write_one_file."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def write_one_file(lines: DataFrame, path: str, order: list[str], again: bool = False) -> None:
    """The column `value` of lines as one text file in the order of the columns (and of value, where these are equal).

    Lines are dealt by ranges of the order, and the bytes of the ranges before tell each where it begins. So every task writes
    its own stretch of the file, text moves once, and none meets in one task or the driver. The path must lie in a file system that all tasks mount. An
    older file is replaced once all is written. Null lines are left out.

    Dealt lines are saved, as their sizes must be known before they are written. again: lines come out the same each time
    they are made, as row by row from stored tables; then only sizes are saved, and text is made once more to be dealt and
    written. Lines that differ after all raise, as their ranges don't meet.
    """
    spark = lines.sparkSession
    spark.dataSource.register(OneFile)
    order = list(dict.fromkeys([*order, "value"]))
    order = order[: order.index("value") + 1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.filter("value is not null").select(*order)
    size = F.octet_length("value").cast("long") + 1
    if again:
        key = F.struct(*order[:-1], F.substring("value", 1, 64).alias("head"))  # equal orders are parted by how lines begin
        sizes = saved(lines.select(key.alias("key"), size.alias("size"))).repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.sum("size").alias("size"), F.min("key").alias("low"))
    else:
        ranged = saved(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("number"), "value"))
        in_range = F.shiftright("number", 33)  # of a number the rest counts the lines of its range
        sizes = ranged.groupBy(in_range.alias("range")).agg(F.sum(size).alias("size"))
    by_range = Window.orderBy("range")
    begins = sizes.withColumn("begin", F.coalesce(F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begins = saved(begins.withColumn("high", F.lead("low").over(by_range)) if again else begins)  # a small row a range
    total = begins.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    with shuffles_freed(spark):
        if again:
            placed = lines.join(F.broadcast(begins.drop("size")), (key >= F.col("low")) & (F.col("high").isNull() | (key < F.col("high"))))
            placed = placed.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", *order).withColumn("number", F.monotonically_increasing_id())
        else:
            placed = ranged.join(F.broadcast(begins), in_range == F.col("range"))
        placed.select("number", "begin", "value").write.format("one_file").mode("append").option("run", uuid.uuid4().hex).option("size", total).save(path)


def table_lines(frame: DataFrame, order: list[str], header: bool = True) -> tuple[DataFrame, list[str]]:
    """Rows as lines with tabs (null as nothing), the names first if there is a header; and the order of the lines."""
    row = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in frame.columns])
    names = [f"__{i}" for i in range(len(order))]
    lines = frame.select(F.lit(1).alias("__part"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], row.alias("value"))
    if header:
        head = frame.sparkSession.createDataFrame([(0, "\t".join(frame.columns))], "__part int, value string")
        lines = lines.unionByName(head, allowMissingColumns=True)
    return lines, ["__part", *names]


def write_table(frame: DataFrame, path: str, order: list[str], header: bool = True) -> None:
    """A table as one file of lines with tabs, in the order of the columns."""
    lines, by = table_lines(frame, order, header)
    write_one_file(lines, path, by)
