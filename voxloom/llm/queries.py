"""The queries op1 to op13 over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .classifier import score_documents
from .mixing import mix_oracle, plan_mix
from .ngram_join import ngram_jaccard_components, ngram_oracle
from .filters import audit_filters, audit_oracle, text_failures
from .packing import byte_bpe_encoder, pack_documents
from .pieces import encode_texts
from .repair import audit_conversations, damage, repair_oracle
from .rules import quality_verdicts
from .secrets import describe, find_secrets
from .sharding import assign_shards
from .topk import exact_top_k, top_k_oracle
from .warc import warc_oracle, warc_round_trip

#: The split pattern of the byte-level vocabulary: a fixed value.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0, keep=["doc_id"])
    return plan.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", F.array(chat.text_part(F.col("text"))).alias("parts"))
    out = chat.format_chats(turns).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_by_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_by_turn.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = describe(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), describe(F.col("spans")).alias("spans"))


def public_path(name: str) -> str:
    """The place of a public vocabulary file. The package that knows it is imported only where a file is wanted."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_byte_bpe(path: Callable[[str], str] = public_path):
    """The 50k byte-level tokenizer of the public vocabulary files; ``path`` gives a file's place by its name."""
    return byte_bpe_encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), BYTE_BPE_PATTERN)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_byte_bpe(), capacity=1024, end_id=2)


def op11_sentencepiece(spark: SparkSession, sf_dir: str, path: Callable[[str], str] = public_path) -> DataFrame:
    model = path("piece_bpe_32k.model")
    encoded = encode_texts(_table(spark, sf_dir, "documents"), model, spans=False, pack=True, decoded=True)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), sha(F.col("ids")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"), "span_bytes")


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = audit_conversations(damage(turns)).select(F.struct("*").alias("found"))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found.conv_id")), "left")
    counts = [F.coalesce(F.col(f"found.{c}"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("found.audit", F.lit("")).alias("audit"), F.coalesce("found.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = text_failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return audit_filters(failures, "ABCDE", marks=("good", "toxic")).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc": op3_warc,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_shard_documents": op7_shard_documents,
    "op8_format_chats": op8_format_chats,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_repair_conversations": op12_repair_conversations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_oracle(),
    "op2_mix_sources": mix_oracle(),
    "op3_warc": warc_oracle(),
    "op6_exact_top_k": top_k_oracle(),
    "op8_format_chats": chat.chat_oracle(),
    "op12_repair_conversations": repair_oracle(),
    "op13_filter_audit": audit_oracle(),
}
