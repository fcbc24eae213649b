"""Registered queries of the operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.llm import chat, decontaminate, lines, packing, quality, secrets, sharding, simhash, suffixes, topk
from versionlog.llm.common import ensure_checkpoint_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=packing.vocabulary("byte_bpe_50k.json"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign_shards(table(spark, sf_dir, "documents")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


#: A conversation whose texts hold the template's own marks.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(CONTROL).alias("text"),
    )
    log = chat.events(rows.unionByName(added.withColumn("turn", F.col("turn").cast("long"))))
    return chat.digest(chat.format_chats(log))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a stored ledger, new for each call, so that the result does not hang on earlier calls."""
    ledger = f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    return secrets.digest(secrets.scan_with_ledger(table(spark, sf_dir, "documents"), ledger))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_suffixes": op1_suffixes,
    "op2_packing": op2_packing,
    "op3_lines": op3_lines,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_topk": op6_topk,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_suffixes": suffixes.ORACLE,
    "op3_lines": lines.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op9_chat": """
        WITH rows AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   replace(replace(coalesce(role, ''), '\\', '\\\\'), '<|', '<\\|') AS role_out,
                   replace(replace(coalesce(text, ''), '\\', '\\\\'), '<|', '<\\|') AS text_out
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + length(role_out) + length(text_out)) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
}
