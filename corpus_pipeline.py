"""Documents to training sequences: toxic ones go, near-duplicates go, repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import packing, similar, substring, toxicity
from lamella.llm.shared import delete_path, fresh, new_path, scratch_scope, small_batches, written
from lamella.llm.wordbpe import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the documents at hand and the table ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(docs, labels).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays.

    Groups are those of SimHash, joined by verified links of a similarity of 0.8 in five-word shingles.
    Rows that repeat an id with another text, and rows without an id, take part by a key of their
    own; rows without an id lead a group only if none in it has one. Of rows with neither id nor text one stays.
    """
    row, often = fresh(docs, "_row", "_often")
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated, _ = written(ids.filter("n > 1").select(F.col("doc_id").alias(often)), "repeated")
    own = F.when(F.col("doc_id").isNull() | F.col(often).isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = docs.filter("doc_id IS NOT NULL OR text IS NOT NULL").join(repeated, F.col("doc_id") == F.col(often), "left").withColumn(row, own)
    groups = similar.near_duplicates(keyed, doc_id=row)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", row)).alias("first")
    rows = keyed.select(F.col(row), F.col("doc_id").alias("id")).distinct().join(groups, F.col(row) == F.col("doc_id")).select(F.col("id").alias("doc_id"), row, "component_id")
    first = rows.groupBy("component_id").agg(least).select(F.col(f"first.{row}").alias("_first"))
    kept = keyed.join(first, F.col(row) == F.col("_first"), "left_semi").dropDuplicates([row]).select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL AND text IS NULL").dropDuplicates(["text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too are cut; every document stays."""
    return substring.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, default_path())


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("substring dedup", cut_repeats), ("best-fit packing", pack_sequences)]

#: The stages learn a model, chain links and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the table ``documents``, each stage's rows written and read again; what a stage keeps for itself goes when its rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{k}")
        with scratch_scope(spark), small_batches(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
