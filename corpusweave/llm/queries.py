"""The operators of this part aimed at the given tables."""

from __future__ import annotations

import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import (
    html_text,
    near_duplicates,
    neighbours,
    packing,
    pieces,
    repeats,
    sharding,
    spelling,
    topk,
    toxicity,
    urls,
    vector_links,
    whitening,
)

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_random_projection_forest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_subspace_pigeonhole(spark: SparkSession, sf: str) -> DataFrame:
    return vector_links.vector_links(table(spark, sf, "embeddings"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encoded(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op5_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select(
        "record.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text")
    )


def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(pages, rules).withColumnRenamed("url", "judged")
    return pages.join(judged, F.col("url").eqNullSafe(F.col("judged"))).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf, "labels").select("doc_id", "toxic"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("is_toxic").alias("predicted"),
    )


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    dealt = sharding.external_shuffle(docs, size, place=[F.col("_file"), F.col("_at")])
    return dealt.select(
        "record.doc_id",
        "size",
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf, "pages"))
    return found.select(
        "record.page_id",
        "record.url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"),
    )


def op10_minhash(spark: SparkSession, sf: str) -> DataFrame:
    linked = near_duplicates.near_duplicates(table(spark, sf, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op11_exhaustive_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_chebyshev_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents").select("doc_id", "text"))


LLM_QUERIES = {
    name: query for name, query in vars(sys.modules[__name__]).items() if name.startswith("op")
}
