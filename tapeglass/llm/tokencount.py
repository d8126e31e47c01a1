"""Token counts through a digest cache: only distinct content that was never counted is encoded."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tapeglass.llm.common import arrow_map, cut, tokenizer_path

CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens long"


def file_digest(path: str) -> str:
    """The tokenizer's version: a digest of its file, so a changed file never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(docs: DataFrame, cache_dir: str) -> DataFrame:
    spark = docs.sparkSession
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_misses(misses: DataFrame, model_file: str) -> DataFrame:
    """(content_sha256, n_tokens) of distinct contents, counted by the sentencepiece library."""

    def make():
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [len(ids) for ids in model.encode(batch.column("content").to_pylist(), num_threads=1)]
            return pa.RecordBatch.from_arrays(
                [batch.column("content_sha256"), pa.array(counts, pa.int64())], names=["content_sha256", "n_tokens"]
            )

        return work

    return arrow_map(misses.select("content_sha256", "content"), make, "content_sha256 string, n_tokens long", rows=64)


def count_tokens(docs: DataFrame, cache_dir: str, limit: int = 4096, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, and the new counts appended to ``cache_dir``.

    The content digest is sha256 of the text normalised as this tokenizer does it, which is
    the identity with null read as empty; so equal digests mean equal ids. Counts carry no
    begin or end token. Null and empty text: 0 bytes, 0 tokens. Repeated rows each give a
    row. Extra columns are not read. A cache that holds a digest twice (two writers at once)
    is read as one entry.
    """
    model_file = model_file or tokenizer_path("piece_bpe_32k.model")
    version = file_digest(model_file)
    content = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("content_sha256"))
    known = (
        read_cache(docs, cache_dir)
        .where(F.col("tokenizer_sha256") == version)
        .groupBy("content_sha256")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    texts = docs.select(F.sha2(content, 256).alias("content_sha256"), content.alias("content"))
    # One row per distinct miss: copies meet on the map side first, so a hot text is not shuffled whole.
    misses = texts.join(known, "content_sha256", "left_anti").dropDuplicates(["content_sha256"])
    found = encode_misses(misses, model_file)
    fresh = cut(found.select("content_sha256", F.lit(version).alias("tokenizer_sha256"), "n_tokens"), "token-counts")
    fresh.write.mode("append").parquet(cache_dir)
    counts = known.unionByName(fresh.select("content_sha256", "n_tokens"))
    return keyed.join(counts, "content_sha256", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
