"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs, sf_dir) and works on all rows that the
stage before it kept; all but the last return the columns of ``documents``. Decisions are made row by row: rows that share an
id, or have none, stay or go by what they hold. Columns beyond those of ``documents`` stay, whatever their names.

Stages share nothing but what they are given. ``run`` writes each stage's result and rereads it, and deletes the tables that the stage's
operators made on the way and the result before; a caller of single stages deletes such tables by ``voxloom.scratch.clear`` or ``deleted_after``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.columns import packed, unpacked
from voxloom.llm.mixing import mix_sources
from voxloom.llm.ngram_join import ngram_jaccard_components
from voxloom.llm.packing import pack_documents
from voxloom.llm.queries import public_byte_bpe
from voxloom.llm.rules import kept_documents
from voxloom.llm.secrets import redact_secrets
from voxloom.scratch import Scratch, deleted_after


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text fails the base rules or a learned rule go; the rest is unchanged."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles one row stays: that with the smallest doc_id, null last, and of those the one with
    the least hash of its text; of rows that repeat both any one. Rows without words stay."""
    scratch = Scratch(spark, "copies")
    found = ngram_jaccard_components(docs.select("doc_id", "text", F.xxhash64("text").alias("tag")), tag_col="tag")
    key = [F.col("doc_id").alias("id"), "tag"]
    #: Keys that go, and keys that several rows of which one stays have.
    gone = found.where("not chosen").select(*key).distinct()
    again = found.where("chosen and n_shingles > 0").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select("id", "tag")
    gone, again = scratch.put(gone, "gone"), scratch.put(again, "again")
    own = docs.select(packed(docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_tag"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tag") == F.col("tag"))
    if again.isEmpty():
        return own.join(gone, same, "left_anti").select(*unpacked("row", docs.columns))
    one = own.join(again, same, "left_semi").groupBy("own_id", "own_tag").agg(F.first("row").alias("row")).select("row")
    return own.join(gone.unionByName(again), same, "left_anti").select("row").unionByName(one).select(*unpacked("row", docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become their kinds; n_chars follows the text."""
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return redact_secrets(docs).select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: documents stay out, stay, or are repeated."""
    return mix_sources(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return pack_documents(docs, public_byte_bpe(), capacity=1024, end_id=2)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the learned rules nor the tokenizer, so there is none; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with deleted_after():
            docs = scratch.put(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
