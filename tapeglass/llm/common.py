"""Shared helpers of the training-data operators: inputs, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lives; the files are never copied into the repository."""
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where the setting is absent a
    local one is made in local mode (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tapeglass/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a
    lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask for a collection in the driver, after which Spark deletes the shuffle files of plans that
    nothing refers to any more; else they stay until the driver's heap fills up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int = 1024
) -> DataFrame:
    """mapInArrow over slices of at most ``rows`` rows. ``make`` runs once per task,
    so models load there and not in the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def words_of(text: str) -> list[bytes]:
    """Words are maximal runs outside space and \\t..\\r, which is what bytes.split does."""
    return text.encode("utf-8", "surrogatepass").split()


class WordCache(dict):
    """Word -> value, computed on a miss. Emptied when ``limit`` words are held; words longer than
    ``longest`` characters are not held, so memory stays bounded by the product of both on any
    vocabulary and script. Values never depend on that."""

    def __init__(self, compute: Callable, limit: int = 400_000, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, word):
        if len(word) > self.longest:
            return self.compute(word)
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.compute(word)
        return value


#: crc32 of the bytes of a text by its definition, as DuckDB has none: a table of one row, t, and the value of a text beside it.
CRC_TABLE_SQL = """crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(text: str) -> str:
    byte = f"('0x' || substr(hex({text}), 2 * j + 1, 2))::BIGINT"
    bytes_of = f"list_transform(range(octet_length(encode({text}))), lambda j: {byte})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bytes_of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
