"""One ordered file for a sink, written at its places by all tasks."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from scaffweave.operators import onefile as of
from scaffweave.operators import sinks
from scaffweave.params import ScaffoldParams
from scaffweave.plans.scaffolder import Scaffolder


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_lines_stand_in_order(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(n // 3 + 1), rng.choice(["", "é", "line " * rng.randrange(9)]) + str(rng.randrange(50))) for i in range(n)]
    frame = spark.createDataFrame([*rows, (0, None)], "k int, value string").repartition(7)
    path = tmp_path / "deep" / "out.txt"
    for _ in range(2):  # an older file is replaced
        of.write_one_file(frame, str(path), ["k"])
        assert path.read_text() == "".join(f"{v}\n" for _, v in sorted(rows, key=lambda r: (r[0], r[1].encode())))
    assert os.listdir(path.parent) == ["out.txt"]


def test_a_file_that_is_not_whole_is_not_committed(tmp_path):
    writer = of._Writer({"path": str(tmp_path / "x"), "run": "r", "size": "5"})
    with pytest.raises(OSError, match="3 of 5 bytes"):
        writer.commit([of._Wrote(3)])
    assert os.listdir(tmp_path) == []


def test_tables_of_a_run_are_one_file_each(spark, tmp_path):
    imap = spark.createDataFrame([(b, c, h, 6) for b in "ABCDE" for c, h in (("1", False), ("2", True))], "barcode string, contig string, is_head boolean, n int")
    mult = spark.createDataFrame([(b, 24) for b in "ABCDE"], "barcode string, mult int")
    lengths = spark.createDataFrame([("1", 1000), ("2", 900)], "contig string, length int")
    s = Scaffolder(ScaffoldParams(inputs=("x.sam",), min_mult=1, base_name=str(tmp_path / "out")))
    result = s.from_counts(imap, mult, lengths)
    result.extra |= {"bx_mult": spark.createDataFrame([(2, 4), (1, 6)], "barcode long, n long"), "params": [spark.createDataFrame([(7,)], "span long"), spark.createDataFrame([(1200,)], "read_p50 long")]}
    s.write_tables(result)
    text = lambda name: (tmp_path / name).read_text()
    assert text("out_main.tsv").split("\n") == ["U\tV\tBest_orientation\tShared_barcodes\tU_barcodes\tV_barcodes\tAll_barcodes", "1+\t2+\tT\t5\t5\t5\t5", "2-\t1-\tT\t5\t5\t5\t5", ""]
    assert text("out.tigpair_checkpoint.tsv") == "10\tf1\tf2\t5\t500\n10\tr2\tr1\t5\t500\n"
    assert json.loads(text("out_stats.json"))["All_barcodes_filtered"] == 5
    assert text("out_bx_mult.tsv") == "1\t6\n2\t4\n" and text("out_params.tsv") == "read_p50\t1200\nspan\t7\n"


def test_tables_keep_nulls_and_numbers_in_order(spark, tmp_path):
    frame = spark.range(1000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b")).repartition(5)
    of.write_table(frame, f"file:{tmp_path}/t.tsv", ["a"])
    lines = (tmp_path / "t.tsv").read_text().splitlines()
    assert lines == ["a\tb", *[f"{i}\t{i if i % 3 else ''}" for i in range(1000)]]
    assert sinks.main_table(frame.withColumnRenamed("a", "u")).columns == ["U", "b"]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_lines_made_again_are_not_saved(spark, tmp_path, n):
    """The same file as from saved lines; the shared folder gets their sizes alone, and nothing shuffled stays."""
    from scaffweave.operators.numbering import shared_folder

    def held(folder, data=""):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if data in f)

    rng = random.Random(n)
    letters = lambda: "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 900])))
    rows = [(rng.choice([None, rng.randrange(n // 3 + 1)]), "same line " * 8 + letters()) for _ in range(n)] + [(0, None)]
    spark.createDataFrame(rows, "k int, value string").repartition(7).write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    of.write_one_file(frame, str(tmp_path / "out.txt"), ["k"])
    before, local = held(shared_folder(spark)), spark.conf.get("spark.local.dir")
    shuffled = held(local, "shuffle_")
    of.write_one_file(frame, str(tmp_path / "again.txt"), ["k"], again=True)
    text = (tmp_path / "again.txt").read_bytes()
    assert text == (tmp_path / "out.txt").read_bytes() and text.count(b"\n") == n
    assert held(shared_folder(spark)) - before < 100_000 + 50 * n
    for _ in range(100):  # files are freed a moment later
        if held(local, "shuffle_") <= shuffled + 20_000:
            break
        time.sleep(0.1)
    assert held(local, "shuffle_") <= shuffled + 20_000


def test_lines_that_are_not_the_same_again_raise(spark, tmp_path):
    frame = spark.range(2000).select("id", F.repeat(F.lit("x"), (F.rand() * 50).cast("int")).alias("value"))
    drawn = frame.withColumn("value", F.concat("value", F.udf(lambda: "y" * random.randrange(90), "string").asNondeterministic()()))
    with pytest.raises(Exception, match="bytes of"):
        of.write_one_file(drawn, str(tmp_path / "x.txt"), ["id"], again=True)
    assert not os.path.exists(tmp_path / "x.txt")
