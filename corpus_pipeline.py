"""A corpus pipeline of five stages over documents; each stage reads what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scaffweave.llm.common import shared_folder
from scaffweave.llm.decontam import find_contamination
from scaffweave.llm.language import UNKNOWN, fit_prototypes, identify_languages
from scaffweave.llm.minhash import near_duplicates
from scaffweave.llm.packing import pack, pieces
from scaffweave.llm.queries import tokenizer_path
from scaffweave.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Similarity, in hundredths, from which the near-dedup stage takes documents for copies.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; those with no letters go (null and empty texts too).

    A null lang gets the prediction. If no language can be learned, as no lang is given, every document with a
    letter stays as it is. Null and repeated ids and repeated rows stay; very long texts are read whole; ties go
    to the first name. An empty table gives an empty one; columns that are not of documents are left out.
    """
    model = fit_prototypes(docs)
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = identify_languages(docs, model, keep=COLUMNS)
    kept = judged.filter(F.col("lang_pred") != UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, and documents with no words.

    Documents are near-duplicates from a similarity of NEAR / 100 of their word 5-shingles on. What is judged is
    a row's doc_id and text together (by a 64-bit hash of both): rows that share an id but have different texts
    are documents of their own, rows equal in both are one. A null id is the largest: of a group with no other
    ids one row stays. Of rows of a group with the same id that with the smallest hash stays. Null and empty
    texts are like nothing else and stay. Very long texts are read whole. An empty table gives an empty one;
    columns that are not of documents are left out.
    """
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")).dropDuplicates(["row"])
    judged = near_duplicates(rows, key="row", percent=NEAR).select("row", "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = judged.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(least.alias("least")).select("least.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words that a document with a smaller id has; documents of which nothing is left go.

    What was cut leaves the other words joined by single spaces, and n_chars is counted anew; other documents
    stay as they are, those with no words too. A null id comes after all others. Repeated rows of one id keep
    the passages that they share. An empty table gives an empty one; other columns are left out.
    """
    cut = remove_repeats(docs.select(*COLUMNS), with_text=True).filter("n_words = 0 or n_removed < n_words")
    return cut.withColumns({"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words that lie in a window of the benchmark; documents of which nothing is left go.

    Documents with no hit stay as they are, those with no words too; n_chars of others is counted anew. Null and
    repeated ids and repeated rows are judged row by row. An empty table or benchmark changes nothing; other
    columns are left out.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select(*COLUMNS), benchmark).filter("n_words = 0 or n_hit < n_words")
    return found.withColumns({"text": F.col("clean_text"), "n_chars": F.when(F.col("n_hit") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences that the documents are packed into, a row for each piece.

    Every row is packed, repeated ones and null ids too; a null or empty text is its end token alone. Very long
    texts are cut into pieces of 2048 tokens. An empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: No SQL states the stages with learned models, sketches and the genetic algorithm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
