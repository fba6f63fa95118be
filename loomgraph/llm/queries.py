"""The registered queries: thin digests over the operators, whole tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, context_mixing, decontaminate, language_id, line_dedup, ngram_join, quality_model, quality_rules, repeats, url_filters
from .common import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public byte-level vocabulary of the default queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_digest(encoded: DataFrame, path: str) -> DataFrame:
    """n_tokens and the two digests, from token_ids through the decoder."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    df = encoded.drop(*new).withColumns({"n_tokens": F.size("token_ids").cast("long"), "ids_sha256": F.sha2(ids, 256)})
    return bpe.decode(df, path).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded", "token_ids")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.quality_rules(docs, carry=["doc_id"]).select("doc_id", *cols)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    spans = F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"]))
    digest = F.sha2(F.array_join(spans, ","), 256).alias("spans_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated", F.size("spans").cast("long").alias("n_spans"), digest)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digest(bpe.encode(docs, path, keep_text=False), path)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.mixing_scores(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_decontaminate,
        op3_language_id,
        op4_url_filters,
        op5_bpe,
        op6_ngram_join,
        op7_quality_model,
        op8_context_mixing,
        op9_repeats,
        op10_line_dedup,
    )
}
