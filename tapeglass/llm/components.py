"""Connected components of a link table: distributed union-find by star contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.common import cut, drop_cut


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b: longs); root is the smallest
    node of the component.

    Each round hangs every node's larger neighbours on its smallest neighbour and then
    every node on its smallest smaller neighbour, which halves the distances; it ends when
    a round changes nothing. Self-links, repeated links and null ends are ignored. Rounds
    are cut through the shared folder; a node with very many links is a skewed join key,
    which Spark splits, and is aggregated before the shuffle.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges, "components")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = mark(hung)
        drop_cut(edges)
        edges = hung
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def bit_filter(keys: DataFrame, column: str, bits_per_key: int = 16, most_words: int = 1 << 18) -> DataFrame:
    """(word, mask): a one-hash bit set of a long column, at most ``most_words`` rows, so it can
    be broadcast whatever the size of ``keys``. It only ever lets too much through."""
    count = keys.count()
    words = 64
    while words < most_words and words * 64 < count * bits_per_key:
        words *= 2
    spot = F.xxhash64(F.col(column), F.lit("bit"))
    return keys.select(
        F.pmod(spot, F.lit(words)).cast("int").alias("word"), F.shiftrightunsigned(spot, 58).cast("int").alias("bit"), F.lit(words).alias("words")
    ).groupBy("word", "words").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def passes_bits(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` may be among the keys of :func:`bit_filter`."""
    first = bits.select("words").first()
    words = first["words"] if first else 64
    spot = F.xxhash64(F.col(column), F.lit("bit"))
    return (
        rows.withColumn("word", F.pmod(spot, F.lit(words)).cast("int"))
        .withColumn("bit", F.shiftrightunsigned(spot, 58).cast("int"))
        .join(F.broadcast(bits.drop("words")), "word")
        .where(F.expr("shiftrightunsigned(mask, bit) & 1L = 1L"))
        .drop("word", "bit", "mask")
    )
