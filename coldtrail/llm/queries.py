"""One registered query for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from coldtrail.llm import chat, conversation_repair, exact_dedup, filter_audit, html, lm, mixing, oracle, packing, quality, secrets, simhash, suffix_dedup, toxicity
from coldtrail.llm.common import table

#: The conversation that the chat query adds: texts that hold the look of control strings and of escapes.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.language_model_scores(table(spark, folder, "documents"))


def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def secret_digests(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents"))

    def listed(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number("crf"))


def quality_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents"))


def chat_digests(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    probe = spark.range(1).select(F.lit(PROBE_ID).cast(kind).alias("conv_id"), F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(PROBE_TEXT).alias("content")) for role in ("user", "assistant")]).alias("messages"))
    turns = chat.canonical_turns(rows, "conv_id").unionByName(chat.canonical_turns(probe, "conv_id"))
    return chat.digests(chat.format_chats(turns), "conv_id")


def packed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(table(spark, folder, "pages"), "page_id", "html", "url")


def mixed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def repeats_removed(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def filter_steps(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return conversation_repair.repair_conversations(rows, present=F.col("present")).withColumn("repaired_sha256", F.sha2(whole, 256)).drop("turns")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scores,
    "op2_simhash": simhash_components,
    "op3_toxicity": toxicity_scores,
    "op4_exact_dedup": exact_groups,
    "op5_secret_scan": secret_digests,
    "op6_quality_rules": quality_verdicts,
    "op7_chat_format": chat_digests,
    "op8_packing": packed_pieces,
    "op9_html_text": page_texts,
    "op10_source_mixing": mixed_documents,
    "op11_suffix_dedup": repeats_removed,
    "op12_filter_audit": filter_steps,
    "op13_conversation_repair": repaired_conversations,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
