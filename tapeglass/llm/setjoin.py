"""Exact Jaccard join of word 5-gram sets by a universe partition.

Shingles are 64-bit hashes. For each size band the hash universe is cut into segments
(contiguous ranges; below SMALL shingles every shingle is a segment of its own). Two sets
of similarity 3/4 or more differ in at most H = (|r| + |s|) / 7 shingles, so if the larger
set s asks for segments with allowances t (1: the segments' subsets must be equal, 2: they
may differ by one shingle) that add up to H + 1, some segment must answer: the pigeonhole
principle. Allowances are allocated by cost: segments whose subset is frequent in the
corpus are asked last, and before that one-deletion neighbourhoods are used in the
segments that have them in the index. Every candidate is verified on the whole sets.

Sets that are equal are one node, known by a digest of the set. Index and probe entries go
through the shuffle packed by bucket; equal sets of a task are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.llm.common import WordCache, arrow_map, cut, drop_cut, free_shuffles, shuffle_count
from tapeglass.llm.components import bit_filter, connected_components, passes_bits

GRAM = 5
SMALL = 64  # sets below this size use one segment per shingle
SEGMENTS_PER_SHINGLE = 0.38
DELETION_EVERY = 16  # segments 0, 16, 32, ... have one-deletion neighbourhoods in the index
FLUSH = 1_000_000  # entries that a task packs at once
HOT, HOT_TABLE = 8, 1 << 19  # signatures of so many sets are hot; the cost table keeps the most frequent ones
SMALL_GROUP = 8
BLOCK = 512  # sets of a cluster that are compared at once
INDEX, DELETED, PROBE, WIDE, NEAR = 1, 2, 4, 8, 16  # kinds of entry: index full/deleted; probe full t=1, full t=2, deleted

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PLACES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * K2
    x = (x ^ (x >> np.uint64(29))) * K1
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Text -> sorted distinct 64-bit shingle hashes."""

    def __init__(self) -> None:
        self.words = WordCache(xxhash.xxh3_64_intdigest, limit=400_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change case
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - GRAM + 1)
        key = np.full(n, min(len(h), GRAM), dtype=np.uint64)
        for i in range(min(GRAM, len(h))):
            key += h[i : i + n] * PLACES[i]
        key = mix(key)
        key.sort()
        return key[np.concatenate([[True], key[1:] != key[:-1]])]


@lru_cache(maxsize=1)
def shingler() -> Shingler:
    """One per worker process, so that its tasks share the word cache."""
    return Shingler()


def digest_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def band_edges(limit: int = 1 << 40) -> np.ndarray:
    """Band k holds sizes edges[k] <= n < edges[k + 1]; sets linked lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges, dtype=np.int64)


EDGES = band_edges()


def segments(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, segment numbers) of the non-empty segments of a sorted set in the band's scheme."""
    top = int(EDGES[band + 1])
    if top <= SMALL:
        n = len(shingles)
        return np.arange(n), np.ones(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    count = int(np.ceil(top * SEGMENTS_PER_SHINGLE)) + 3
    number = ((shingles >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return starts, np.diff(np.append(starts, len(shingles))), number[starts]


def signature(sums: np.ndarray, number: np.ndarray, band: int) -> np.ndarray:
    return mix(sums + mix(number.astype(np.uint64) * K2 + np.uint64(band + 1)))


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def short(sig: np.ndarray) -> np.ndarray:
    """32 bits of a signature that tell it from the others of its bucket."""
    return (sig * K1 >> np.uint64(32)).astype(np.uint32)


class Costs:
    """How many sets share a signature, for the hot ones; 0 for any other."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts

    def __call__(self, sig: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(sig), dtype=np.int64)
        key = (sig & np.uint64(0xFFFFFFFF00000000)) | short(sig).astype(np.uint64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.counts[at], 0)


NO_COSTS = Costs(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def allocate(sizes: np.ndarray, cost: np.ndarray, deletable: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked with allowance 1 or 2, asked with allowance 2): cheap segments first, larger ones
    before smaller; where those that are not hot fall short, deletable ones get allowance 2
    before hot ones are asked."""
    order = np.lexsort((-sizes, cost))
    chosen = order[:need]
    hot = int((cost[chosen] > 0).sum())
    missing = need - len(chosen) + hot
    wide = np.zeros(0, dtype=np.int64)
    if missing:
        wide = np.array([i for i in chosen if cost[i] == 0 and deletable[i] and sizes[i] > 1][:missing], dtype=np.int64)
        gain = len(wide) - (need - len(chosen))
        if gain > 0:
            chosen = chosen[: len(chosen) - min(gain, hot)]
        elif gain < 0:
            raise ValueError("too few segments for the pigeonhole bound")
    return chosen, wide


def entries_of(shingles: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray, int]:
    """(signatures, kinds, popularity) of one set: index entries in its own band's scheme and
    probes in its own and the next smaller band's; popularity is the mean cost of its own."""
    n = len(shingles)
    own = int(np.searchsorted(EDGES, n, side="right")) - 1
    mixed = mix(shingles)
    sigs, kinds = [], []
    for band in (own, own - 1):
        if band < 0:
            continue
        starts, sizes, number = segments(shingles, band)
        sums = np.add.reduceat(mixed, starts)
        full = signature(sums, number, band)
        cost = costs(full)
        if band == own:
            popularity = int(cost.mean() * 16)
        deletable = (number % DELETION_EVERY == 0) & (EDGES[band + 1] > SMALL)
        largest = n if band == own else min(n, int(EDGES[own]) - 1)
        chosen, wide = allocate(sizes, cost, deletable, (largest + n) // 7 + 1)
        kind = np.zeros(len(full), dtype=np.uint8)
        kind[chosen] |= PROBE
        kind[wide] |= WIDE
        if band == own:
            kind |= INDEX
        used = np.flatnonzero(kind)
        sigs.append(full[used])
        kinds.append(kind[used])
        asks = np.zeros(len(full), dtype=bool)
        asks[wide] = True
        near = (np.where(asks, NEAR, 0) | np.where(deletable & (band == own), DELETED, 0)).astype(np.uint8)
        if near.any():
            each = np.repeat(np.arange(len(full)), sizes)
            pick = near[each] > 0
            each = each[pick]
            sigs.append(signature(sums[each] - mixed[pick], number[each], band))
            kinds.append(near[each])
    return np.concatenate(sigs), np.concatenate(kinds), popularity


def describe(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per document (doc_id, key, n, digest): key is a hash of the text, digest one of the
    shingle set (0 if empty). Besides, rows (bucket, sigs): the full signatures of a task's
    distinct sets in their own band, packed by bucket, for the cost table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = shingler(), set()
        kept: list[np.ndarray] = []
        held = 0

        def report() -> pa.RecordBatch:
            sig = np.concatenate(kept)
            bucket = bucket_of(sig, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(ends))
            blobs = [sig[order[ends[b] : ends[b + 1]]].tobytes() for b in used]
            none = pa.nulls(len(used), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=DESCRIBED)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle(t) for t in part.column("text").to_pylist()]
                digests = [digest_of(s) if len(s) else 0 for s in sets]
                for s, d in zip(sets, digests, strict=True):
                    if len(s) and d not in seen:
                        seen.add(d)
                        band = int(np.searchsorted(EDGES, len(s), side="right")) - 1
                        starts, _, number = segments(s, band)
                        kept.append(signature(np.add.reduceat(mix(s), starts), number, band))
                        held += len(starts)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                nothing = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), sizes, pa.array(digests, pa.int64()), *nothing], names=DESCRIBED)
                if held > FLUSH:
                    yield report()
                    kept, held = [], 0
        if held:
            yield report()

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n long, digest long, bucket int, sigs binary")


DESCRIBED = ["doc_id", "key", "n", "digest", "bucket", "sigs"]


def count_signatures(table: pa.Table) -> pa.Table:
    """(sig, times) of one bucket's hot signatures."""
    sig = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("sigs").to_pylist()])
    sig.sort()
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    times = np.diff(np.append(starts, len(sig)))
    hot = times >= HOT
    return pa.table({"sig": sig[starts[hot]].astype(np.int64), "times": times[hot].astype(np.int64)})


def frequent_signatures(counted: DataFrame) -> Costs:
    """The cost table: hot signatures with the number of task-wise distinct sets that have
    them, over all documents. It has at most HOT_TABLE rows, the most frequent ones, and
    steers only costs, never results."""
    found = counted.groupBy("bucket").applyInArrow(count_signatures, "sig long, times long")
    rows = found.orderBy(F.desc("times"), "sig").limit(HOT_TABLE).toPandas()
    sig = rows["sig"].to_numpy().astype(np.int64).astype(np.uint64)
    keys = (sig & np.uint64(0xFFFFFFFF00000000)) | short(sig).astype(np.uint64)
    order = np.argsort(keys)
    return Costs(keys[order], rows["times"].to_numpy().astype(np.int64)[order])


SET_TYPE = [("digest", "<i8"), ("n", "<u4"), ("popularity", "<u4")]
ENTRY_TYPE = [("sig", "<u4"), ("set", "<u4")]


def packed_entries(docs: DataFrame, costs: Costs, buckets: int) -> DataFrame:
    """(bucket, sets binary, entries binary): a task's entries by bucket, as (digest i64, size u32,
    popularity u32) of its sets and (signature u32, set number u32 with the kind in the upper byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = shared.value
        shingle, seen = shingler(), set()
        sets: list[tuple[int, int, int]] = []
        sigs: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sig, kind = np.concatenate(sigs), np.concatenate(kinds)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(x) for x in sigs])
            described = np.array(sets, dtype=SET_TYPE)
            bucket = bucket_of(sig, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                pick = order[ends[b] : ends[b + 1]]
                if len(pick):
                    mine, local = np.unique(owner[pick], return_inverse=True)
                    packed = np.empty(len(pick), dtype=ENTRY_TYPE)
                    packed["sig"] = short(sig[pick])
                    packed["set"] = local.astype(np.uint32) | (kind[pick].astype(np.uint32) << np.uint32(24))
                    rows.append((b, described[mine].tobytes(), packed.tobytes()))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                names=["bucket", "sets", "entries"],
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingle(text)
                if not len(s) or (d := digest_of(s)) in seen:
                    continue
                seen.add(d)
                sig, kind, popularity = entries_of(s, costs)
                sets.append((d, len(s), min(popularity, 2**32 - 1)))
                sigs.append(sig)
                kinds.append(kind)
                held += len(sig)
                if held >= FLUSH or len(sets) >= 1 << 20:
                    yield flush()
                    sets, sigs, kinds, held = [], [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, sets binary, entries binary")


def may_link(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)


def groups_of_bucket(table: pa.Table) -> pa.Table:
    """(a, b, members): candidate pairs of small groups and, for a group above SMALL_GROUP, pairs
    of every member with the most popular one (in a group of near copies, the text they were
    made from) and the list of members."""
    described, entries = [], []
    base = 0
    for sets, packed in zip(table.column("sets").to_pylist(), table.column("entries").to_pylist(), strict=True):
        one = np.frombuffer(sets, dtype=SET_TYPE)
        e = np.frombuffer(packed, dtype=ENTRY_TYPE)
        described.append(one)
        entries.append((e["sig"], (e["set"] & np.uint32(0xFFFFFF)).astype(np.int64) + base, (e["set"] >> np.uint32(24)).astype(np.uint8)))
        base += len(one)
    sets = np.concatenate(described)
    sig, owner, kind = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(starts, len(sig)))
    who = sets["digest"][owner[order]]
    kinds = np.bitwise_or.reduceat(kind[order], starts)
    useful = (sizes > 1) & ((kinds & (INDEX | DELETED)) > 0) & ((kinds & (PROBE | WIDE | NEAR)) > 0)
    useful &= np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
    count_of = sets["n"].astype(np.int64)[owner[order]]
    popular = sets["popularity"][owner[order]]
    two = starts[useful & (sizes == 2)]
    ok = may_link(count_of[two], count_of[two + 1])
    pairs_a = [np.minimum(who[two], who[two + 1])[ok]]
    pairs_b = [np.maximum(who[two], who[two + 1])[ok]]
    lists, seen_groups = [], set()
    for g in np.flatnonzero(useful & (sizes > 2)):
        at = slice(starts[g], starts[g] + sizes[g])
        digest, first = np.unique(who[at], return_index=True)
        name = digest.tobytes()
        if name in seen_groups:
            continue
        seen_groups.add(name)
        n = count_of[at][first]
        if len(digest) <= SMALL_GROUP:
            i, j = np.triu_indices(len(digest), 1)
        else:
            lists.append(digest)
            center = int(np.argmax(popular[at][first]))
            others = np.delete(np.arange(len(digest)), center)
            i, j = np.minimum(others, center), np.maximum(others, center)
        ok = may_link(n[i], n[j])
        pairs_a.append(digest[i[ok]])
        pairs_b.append(digest[j[ok]])
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    if len(a):
        a, b = np.unique(np.stack([a, b]), axis=1)
    count = len(a)
    return pa.table(
        {
            "a": pa.array([*a.tolist(), *[None] * len(lists)], pa.int64()),
            "b": pa.array([*b.tolist(), *[None] * len(lists)], pa.int64()),
            "members": pa.array([*[None] * count, *[x.tolist() for x in lists]], pa.list_(pa.int64())),
        }
    )


def sets_of(docs: DataFrame, described: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) of the wanted digests, each made from one of its texts."""
    keys = cut(described.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("key").alias("key")).select("key").distinct(), "join-keys")
    texts = passes_bits(docs.select("key", "text"), "key", bit_filter(keys, "key")).dropDuplicates(["key"]).join(keys, "key", "left_semi")

    def make():
        shingle = shingler()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([digest_of(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["digest", "shingles"],
            )

        return work

    return cut(arrow_map(texts.select("text"), make, "digest long, shingles array<long>", rows=256), "join-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 75 * union."""
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= 75 * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def overlaps(codes: np.ndarray, owner: np.ndarray, rows: int, wide: int = 4096) -> np.ndarray:
    """(rows, rows) shared shingles of sets given as (code, owner) incidences, in slices of the codes."""
    out = np.zeros((rows, rows), dtype=np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    ends = np.append(np.searchsorted(codes, np.arange(0, codes[-1] + 1, wide)), len(codes))
    for a, b in pairwise(ends):
        slab = np.zeros((rows, wide), dtype=np.float32)
        slab[owner[a:b], codes[a:b] % wide] = 1
        out += slab @ slab.T
    return out.astype(np.int64)


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Few edges of a symmetric boolean matrix that join what it joins."""
    label, out = np.arange(len(linked)), []
    while True:
        open_ = linked & (label[:, None] != label[None, :])
        has = np.flatnonzero(open_.any(axis=1))
        if not len(has):
            return out
        for i, j in zip(has.tolist(), open_[has].argmax(axis=1).tolist(), strict=True):
            if label[i] != label[j]:
                out.append((i, j))
                label[label == max(label[i], label[j])] = min(label[i], label[j])


def compare_blocks(table: pa.Table) -> pa.Table:
    """(a, b): links between sets of two blocks of a cluster that are not in one component yet,
    as few as join what all of them join."""
    node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
    sizes = pc.list_value_length(table.column("shingles")).to_numpy().astype(np.int64)
    flat = table.column("shingles").combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(node)), sizes)
    values, codes, times = np.unique(flat, return_inverse=True, return_counts=True)
    again = times[codes] > 1
    found: list[tuple[int, int]] = []
    if again.any():
        dense = np.cumsum(times > 1) - 1
        common = overlaps(dense[codes[again]], owner[again], len(node))
        linked = (100 * common >= 75 * (sizes[:, None] + sizes[None, :] - common)) & (root[:, None] != root[None, :])
        found = spanning_links(linked)
    return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})


def links_inside_groups(groups: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of large groups that the first links have not joined.

    Groups that still hold several components are united into clusters, and a cluster's
    members are compared block against block (BLOCK sets each), so that no task holds more
    than two blocks and no pair becomes a row."""
    rows = groups.select(F.xxhash64("members").alias("grp"), F.explode("members").alias("node")).distinct()
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_groups = rooted.groupBy("grp").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("first")).where("x < y")
    left = cut(rooted.join(open_groups.select("grp", "first"), "grp").select("node", "root", "first").distinct(), "join-open")
    clusters = connected_components(left.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("root", "cluster")
    members = left.select("node", "root").distinct().join(clusters, "node")
    parts = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = spread.select("cluster", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "node", "root")
    carried = pairs.join(sets.withColumnRenamed("digest", "node"), "node")
    return carried.groupBy("cluster", "x", "y").applyInArrow(compare_blocks, "a long, b long")


def link_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, digest) of every row, and (node, root) over the digests that have
    links; no link of similarity 3/4 or more is lost."""
    spark: SparkSession = docs.sparkSession
    buckets = max(16, 2 * shuffle_count(spark))
    first = cut(describe(docs, buckets), "join-described")
    described = cut(first.where("bucket IS NULL").select("doc_id", "key", "n", "digest"), "join-described")
    costs = frequent_signatures(first.where("bucket IS NOT NULL").select("bucket", "sigs"))
    drop_cut(first)
    free_shuffles(spark)
    schema = "a long, b long, members array<long>"
    found = cut(packed_entries(docs, costs, buckets).groupBy("bucket").applyInArrow(groups_of_bucket, schema), "join-groups")
    free_shuffles(spark)  # the packed entries, which are larger than the texts
    pairs = cut(found.where("a IS NOT NULL").select("a", "b").distinct(), "join-pairs")
    groups = found.where("members IS NOT NULL").select("members")
    in_groups = groups.select(F.explode("members").alias("digest"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).unionByName(in_groups).distinct()
    sets = sets_of(docs, described, wanted)
    free_shuffles(spark)
    links = cut(verified(pairs, sets), "join-links")
    drop_cut(pairs)
    free_shuffles(spark)
    roots = cut(connected_components(links), "join-roots")
    more = cut(links_inside_groups(groups, roots, sets), "join-more")
    if more.isEmpty():
        return described, roots
    return described, cut(connected_components(links.unionByName(more)), "join-roots")


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    component_id is the smallest doc_id that links reach, the row's own included. Words are
    runs outside white space with A-Z lower-cased, shingles five words, the whole sequence
    where there are fewer. Null, empty and blank texts have no shingles, link with nothing
    and keep their own doc_id. Equal texts and equal sets are linked; repeated rows give a
    row each. A row with a null doc_id takes part, and its component is the smallest
    non-null doc_id, or null if there is none. Empty tables give no rows; extra columns are
    not read.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text", F.octet_length("text")).alias("key"))
    described, roots = link_sets(keyed)
    least = described.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    rooted = cut(
        least.join(roots, least["digest"] == roots["node"], "left").select("digest", F.coalesce("root", "digest").alias("root"), "least"),
        "join-rooted",
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_digest = rooted.join(smallest, "root").select("digest", "component")
    return described.join(by_digest, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one with the smallest doc_id
    (null last), then the smallest hash of the text. Same columns; documents without
    shingles link with nothing and stay. Of rows that repeat a doc_id and a text one stays
    if they have shingles."""
    text_key = F.xxhash64("text", F.octet_length("text"))
    keyed = docs.select("doc_id", "text", text_key.alias("key"))
    described, roots = link_sets(keyed)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    full = described.where("n > 0").join(roots, described["digest"] == roots["node"], "left")
    full = full.withColumn("root", F.coalesce("root", "digest")).withColumn("place", order).select("root", "place")
    keepers = full.groupBy("root").agg(F.min("place").alias("keeper"), F.count("*").alias("rows"))
    many = keepers.where("rows > 1").select("root", "keeper")
    gone = cut(
        full.join(many, "root").where("place <> keeper").select(F.col("place.doc_id").alias("gone_id"), F.col("place.key").alias("gone_key")).distinct(),
        "join-gone",
    )
    source = docs.withColumn("row_key_of_text", text_key)
    same = source["doc_id"].eqNullSafe(gone["gone_id"]) & (source["row_key_of_text"] == gone["gone_key"])
    left = source.join(gone, same, "left_anti")
    repeated = cut(described.where("n > 0").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "join-repeated")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    again = repeated.select(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key"))
    twice = left["doc_id"].eqNullSafe(again["again_id"]) & (left["row_key_of_text"] == again["again_key"])
    once = left.join(again, twice, "left_anti")
    return once.unionByName(left.join(again, twice, "left_semi").dropDuplicates(["doc_id", "row_key_of_text"])).select(*docs.columns)


# The same rows as SQL: all shared shingles counted, components by repeated minima.
JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT e.b AS d, reach.r FROM reach JOIN both_ways e ON e.a = reach.d
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) m USING (doc_id)
"""
