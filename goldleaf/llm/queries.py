"""The ten operators applied to their whole tables, with their results in the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html_text, language_id, line_dedup, media, minhash, mixing, packing, secrets
from .common import read_table, stored
from .oracles import ORACLE_SQL


def tokenizer_path() -> str:
    """The default vocabulary file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"), bands=45, rows=8, threshold=(85, 100))
    return found.withColumnRenamed("id", "doc_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    return chat.conversation_digests(chat.format_log(chat.as_log(told.unionByName(added))))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~language_id.held_out(docs["doc_id"]))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = stored(packing.tokenised_pieces(docs, tokenizer_path()), "pieces")
    return packing.pack(pieces)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_table(read_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(read_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read_table(spark, sf_dir, "documents"))
    # Training positions in millionths, in order, comma-joined.
    positions = F.array_join(F.transform("positions", lambda p: F.floor(p * 1e6).cast("string")), ",")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", positions.alias("positions"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(read_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_chat_formatting,
        op3_line_dedup,
        op4_language_id,
        op5_best_fit_packing,
        op6_secret_scan,
        op7_html_extraction,
        op8_exact_dedup,
        op9_source_mixing,
        op10_media_columns,
    )
}
