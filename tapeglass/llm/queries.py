"""Queries of the training-data operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeglass.llm.common import new_folder, table
from tapeglass.llm.html_extract import extract_pages
from tapeglass.llm.langid import identify_languages
from tapeglass.llm.linededup import mark_lines
from tapeglass.llm.neardup import NEAR_SQL, near_duplicates
from tapeglass.llm.packing import pack_documents
from tapeglass.llm.pieces import encode_documents
from tapeglass.llm.prefixtrie import TRIE_SQL, prefix_trie
from tapeglass.llm.quality import RATE_SQL, rate_documents
from tapeglass.llm.setjoin import JOIN_SQL, join_documents
from tapeglass.llm.sharding import shard_documents
from tapeglass.llm.tokencount import count_tokens
from tapeglass.llm.urlfilter import ALLOW, BLOCK, Rule, filter_urls
from tapeglass.llm.variants import VARIANTS_SQL, group_variants

URL_RULES = [
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), length=2048)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every distinct text is counted here."""
    return count_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "token-cache"), limit=4096)


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_lines(table(spark, sf_dir, "documents"), similarity=0.75)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_extraction": op5_html_extraction,
    "op6_vector_sharding": op6_vector_sharding,
    "op7_line_quality": op7_line_quality,
    "op8_token_counts": op8_token_counts,
    "op9_nn_descent": op9_nn_descent,
    "op10_line_dedup": op10_line_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op4_jaccard_join": JOIN_SQL,
    "op7_line_quality": RATE_SQL,
    "op9_nn_descent": NEAR_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_spelling_variants": VARIANTS_SQL,
}
