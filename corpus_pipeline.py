"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage takes null texts and labels, empty and very long texts, null and repeated ids (each row is a document of its own, the first of copies stays) and extra columns, which go on
unchanged whatever their names; the last returns the columns of the packing. Documents of null or empty text have no language and go in the first stage. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.llm import op01_ngram_join, op02_language, op04_toxicity, op08_suffix_dedup, op09_packing
from seqprep.llm.common import boxed, chosen, new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return op02_language.keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic."""
    rows, names = boxed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    if names is not None:
        labels = labels.join(names, F.col("doc_id") == F.col("_old")).select(F.col("_seq").alias("doc_id"), "toxic")
    return chosen(rows, op04_toxicity.toxicity(rows, labels).where("predicted = 0").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id."""
    rows, _ = boxed(docs)
    return chosen(rows, op01_ngram_join.ngram_join(rows).where("kept").select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those left without a word go."""
    rows, _ = boxed(docs)
    rest = op08_suffix_dedup.suffix_dedup(rows).select(F.col("doc_id").alias("rest_id"), "kept_text")
    joined = rows.select("doc_id", "row").join(rest, F.col("doc_id") == F.col("rest_id")).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return joined.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("row")[f.name].alias(f.name) for f in docs.schema])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their tokens and their places in sequences."""
    return op09_packing.packed_sequences(docs)


STAGES = [
    ("language_id", language),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: SQL can't express the trained stages. The tests hold the first two to their operators (which have brute-force tests of their own) and the others to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark)  # removed when the driver ends
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
