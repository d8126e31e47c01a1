"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups (rows of equal text) are placed one by one, largest first, on the shard whose
residual capacity has the highest dot product with the group's vector. The driver only
ever holds a bounded list of placements: groups that weigh at least
1 / (shards * HEAVY_PER_SHARD) of a total in some dimension (there are at most
3 * shards * HEAVY_PER_SHARD of them) go in singly, all lighter groups go in as
LIGHT_BUCKETS hash buckets of whole groups. A group above one shard's capacity is split
by a hash of doc_id into the fewest parts that fit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.llm.common import cut

HEAVY_PER_SHARD = 64
LIGHT_BUCKETS = 8192
DIMS = ("size", "tokens", "one")
WEIGHTS = np.array([8.0, 1.0, 1.0])  # of bytes, tokens and rows in the dot product
WORD_GAP = r"[\x20\x09-\x0D]+"


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector: heaviest first, to the shard with the largest dot product of
    vector and residual capacity, dimensions weighed by WEIGHTS. A shard with room for the
    first dimension, the law, goes before one without; if none has room, the one with most
    of it takes the vector. Ties go to the lowest shard."""
    total = vectors.sum(axis=0)
    unit = vectors / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(unit), dtype=np.int64)
    order = np.lexsort((np.arange(len(unit)), -unit.sum(axis=1), -unit.max(axis=1)))
    for i in order:
        v = unit[i]
        fits = residual[:, 0] + 1e-9 >= v[0]
        score = np.where(fits, residual @ (WEIGHTS * v), -np.inf) if fits.any() else residual[:, 0]
        out[i] = k = int(np.argmax(score))
        residual[k] -= v
    return out


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size is the UTF-8 bytes of the text plus 8; law is "bytes". slot counts from 0 without
    gaps inside a shard. Null text: size 8, crc null, one group of its own hash; null doc_id:
    kept, dealt by the hash of null. Repeated rows each get a slot of their own. Empty
    input gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.when(F.length(text) > 0, F.size(F.split(text, WORD_GAP))).otherwise(0).cast("long").alias("tokens"),
            F.lit(1).cast("long").alias("one"),
            F.xxhash64(text, F.octet_length(text)).alias("grp"),
        ),
        "shard-rows",
    )
    groups = cut(
        rows.groupBy("grp").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("one").alias("one")),
        "shard-groups",
    )
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMS]).first()
    least = {d: max(1, total[d] / (shards * HEAVY_PER_SHARD)) for d in DIMS}
    is_heavy = F.lit(False)
    for d in DIMS:
        is_heavy = is_heavy | (F.col(d) >= F.lit(float(least[d])))
    bucket = F.pmod(F.col("grp"), F.lit(LIGHT_BUCKETS)).cast("int")
    heavy = groups.where(is_heavy).orderBy("grp").collect()  # at most 3 * shards * HEAVY_PER_SHARD rows
    light = (  # at most LIGHT_BUCKETS rows
        groups.where(~is_heavy).groupBy(bucket.alias("bucket")).agg(*[F.sum(d).alias(d) for d in DIMS]).orderBy("bucket").collect()
    )
    items: list[tuple] = [(None, r["bucket"], 0, *(float(r[d]) for d in DIMS)) for r in light]
    parts_of: dict[int, int] = {}
    for r in heavy:
        parts = max(1, *(int(np.ceil(r[d] * shards / max(total[d], 1) - 1e-9)) for d in DIMS))
        if parts > 1 and r["one"] > 1:
            parts_of[r["grp"]] = min(parts, r["one"])
        else:
            items.append((r["grp"], None, 0, *(float(r[d]) for d in DIMS)))
    if parts_of:  # a dimension holds at most ``shards`` such groups, cut into at most 6 * shards parts in all
        split = spark.createDataFrame(list(parts_of.items()), "grp long, parts int")
        part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")).cast("int")
        real = rows.join(F.broadcast(split), "grp").groupBy("grp", part.alias("part")).agg(*[F.sum(d).alias(d) for d in DIMS])
        real = {(r["grp"], r["part"]): r for r in real.collect()}
        for grp, parts in parts_of.items():
            items += [(grp, None, p, *(float(real[grp, p][d]) if (grp, p) in real else 0.0 for d in DIMS)) for p in range(parts)]
    where = place(np.array([x[3:] for x in items], dtype=float).reshape(len(items), 3), shards)
    heavy_at: dict[int, list[int]] = {}
    light_at = [0] * LIGHT_BUCKETS
    for (grp, buck, *_), shard in zip(items, where.tolist(), strict=True):
        if grp is None:
            light_at[buck] = shard
        else:
            heavy_at.setdefault(grp, []).append(shard)
    placed = spark.createDataFrame(list(heavy_at.items()), "grp long, at array<int>")
    lights = spark.createDataFrame(list(enumerate(light_at)), "bucket int, light_shard int")
    turn = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.size("at")).cast("int")
    sub_count = max(16, rows.count() // 20_000)
    dealt = (
        rows.join(F.broadcast(placed), "grp", "left")
        .withColumn("bucket", bucket)
        .join(F.broadcast(lights), "bucket", "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce(F.element_at("at", turn + 1), "light_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id"), F.lit(sub_count)).cast("int").alias("sub"),
        )
    )
    dealt = cut(dealt, "shard-dealt")
    # Slots in two passes: rows of each (shard, sub), their prefix sums, then a count inside each.
    counts = dealt.groupBy("shard", "sub").count()
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("at", F.row_number().over(inside).cast("long") - 1)
        .join(base, ["shard", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("at")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
