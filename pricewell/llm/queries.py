"""The operators over the shared tables: one query each, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import (
    host_rules, html_text, lexical_search, line_dedup, ngram_join, pieces, quality, source_mix, substring_dedup, token_alignment, token_files,
    topk_search, url_filter,
)
from pricewell.llm.oracles import ORACLES  # noqa: F401 - offered beside the queries
from pricewell.llm.workers import importable
from pricewell.session import work_dir


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    files = token_files.read(spark, folder)
    rows = files.select("shard", "doc_id", "local_start", F.size("ids").cast("long").alias("n_tokens"), token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))
    return token_files.with_start(rows, files.select("shard", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def learned_from(doc_id: str = "doc_id"):
    """Rows that labels may be learned from; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), learned_from())
    scored = quality.score(docs, model)
    return scored.select("doc_id", (~learned_from()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group_ngrams(table(spark, sf_dir, "documents"), words=4, part=85, whole=100)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text as digests, and whether decoding them gives the text back."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: globals()[name]
    for name in (
        "op1_topk_search", "op2_token_files", "op3_quality", "op4_substring_dedup", "op5_ngram_join", "op6_line_dedup", "op7_host_rules", "op8_pieces",
        "op9_source_mix", "op10_html_text", "op11_token_alignment", "op12_lexical_search", "op13_url_filter",
    )
}
