"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all its
predecessor kept and returns a DataFrame. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.llm import decontaminate, lines, neardup, packing, quality
from versionlog.llm.common import ensure_checkpoint_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier neither rejects nor marks as toxic."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    kept = judged.where("not rejected and not toxic").select(F.col("doc_id").alias("__id"), F.col("text_xxh64").alias("__text")).distinct().hint("shuffle_hash")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__text"]), "left_semi")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of two or more lines."""
    deduped = lines.dedup_lines(docs, windows=True, details=None)
    return deduped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), names=("__words", "__hit", "__items"))
    return found.where("__hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack(docs, tokenizer=packing.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Perplexities, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:  # the stage before is not read any more
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
