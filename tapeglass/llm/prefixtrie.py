"""Prefix trie of conversations by union-find over sorted neighbours.

Each conversation is a row: the digests of its turns in a row of bytes, sorted over all partitions.
Neighbours in that order are joined by edges that carry the length of their longest common prefix
(LCP). A task takes its rows in blocks and joins them by union-find, the edges in descending depth:
every merge at a new depth is a branching node, and the turns above it up to the next are a run of
nodes with the same members. Everything a node holds is a difference of running sums over its rows.
Nodes that a neighbouring block may share lie on the paths of a block's first and last row; these
few are contracted to one row a block, added up by the digest of their prefix, and then are whole.

The list of the conversations that end at a node is hashed as a stream, so no list is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.llm.common import CRC_TABLE_SQL, crc_sql, cut, drop_cut, shuffle_count

WIDTH = 16  # bytes of a turn's digest
BLOCK_ROWS = 4096
BLOCK_TURNS = 100_000
UNKNOWN = -2  # LCP with a row of another task
NONE = -1  # LCP before the first and behind the last row of all
GROUP = 20  # conversations c - c % GROUP to c share first turns
MOST_SHARED = 4
WORDS = r"[^ \t-\r]+"

SORTED = "part int, at long, conv_id long, path binary, words array<int>, before int, behind int"
NODES = (
    "open boolean, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, node binary, parent binary, place long, ends binary"
)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): turns in order (turn, null first, then role and text), a digest of
    role and text, and the words of the text. Rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.expr(f"substring(unhex(sha2(both, 256)), 1, {WIDTH})")
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"), both.alias("both"))
    keyed = rows.select("conv_id", "turn", "role", key.alias("key"), F.xxhash64("text").alias("tie"), F.regexp_count("text", F.lit(WORDS)).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie", "key")
    return keyed.select("conv_id", F.row_number().over(order).alias("pos"), "key", "words")


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, words): each conversation's digests one after the other, and its word counts."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("x")
    whole = rows.groupBy("conv_id").agg(listed)
    joined = F.unhex(F.array_join(F.transform("x", lambda t: F.hex(t["key"])), "")).alias("path")
    return whole.select("conv_id", joined, F.transform("x", lambda t: t["words"]).alias("words"))


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % MOST_SHARED).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation c: the first h turns of conversation c - c % GROUP,
    then its own after its first h, h being crc32(c) % MOST_SHARED."""
    whole = cut(paths(turn_rows(turns)), "conversations")
    head = F.expr(f"substring(path, 1, {WIDTH * MOST_SHARED})")
    base = whole.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), head.alias("head"), F.slice("words", 1, MOST_SHARED).alias("head_words"))
    own = whole.select("*", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    first = F.coalesce(F.expr(f"substring(head, 1, {WIDTH} * h)"), F.lit(b""))
    first_words = F.coalesce(F.slice("head_words", 1, F.col("h")), F.array().cast("array<int>"))
    rest_words = F.slice("words", F.col("h") + 1, F.greatest(F.size("words"), F.lit(1)))
    path = F.concat(first, F.expr(f"substring(path, {WIDTH} * h + 1)"))
    return own.join(base, "base", "left").select("conv_id", path.alias("path"), F.concat(first_words, rest_words).alias("words"))


def common_depth(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their place and the LCP with the rows before and behind."""
    part, at, before = TaskContext.get().partitionId(), 0, UNKNOWN
    held = None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        names = [x.strip().split()[0] for x in SORTED.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for rows in batches:
        for conv_id, path, words in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if held is not None:
                behind = common_depth(held[1], path)
                out.append((part, at, *held, before, behind))
                at, before = at + 1, behind
            held = (conv_id, path, words)
            if len(out) >= 1024:
                yield batch()
                out.clear()
    if held is not None:
        out.append((part, at, *held, before, UNKNOWN))
        yield batch()


def boundary_depths(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For every partition that has rows the LCP of its first row with the last one before, and of its
    last row with the first one behind. Only these numbers reach the driver, two a partition."""
    ends = rows.where((F.col("before") == UNKNOWN) | (F.col("behind") == UNKNOWN)).groupBy("part").agg(
        F.min_by("path", "at").alias("first"), F.max_by("path", "at").alias("last")
    )
    pairs = ends.select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("past"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [NONE if past is None else common_depth(past, first) for first, past in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], ["part", "before"])

    known = sorted((r["part"], r["before"]) for r in pairs.mapInArrow(compare, "part int, before int").collect())
    behind = [b for _, b in known[1:]] + [NONE] * bool(known)
    return {part: (before, after) for (part, before), after in zip(known, behind, strict=True)}


def merged_runs(depths: list[int], lcps: list[int], ids: list[int]) -> list[list[int]]:
    """Runs [left, right, top, bottom, children, ends, smallest id, parent run] of the trie of sorted
    rows: nodes of depth top + 1 to bottom hold the rows left to right; children and ends are those
    of the bottom node. The run with top -1 holds the root, its parent is -1.

    Edge i joins rows i and i + 1. A component is known by its first row; of edges of one depth the
    left ones come first, so the right component of a merge lies deeper or is one row alone."""
    m = len(depths)
    boss = list(range(m))
    right, depth, kids, ends, least = list(range(m)), list(depths), [0] * m, [1] * m, list(ids)
    pending: list[list[int]] = [[] for _ in range(m)]  # runs whose parent is the component's node
    runs: list[list[int]] = []

    def find(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    def close(i: int, top: int) -> int:
        for child in pending[i]:
            runs[child][7] = len(runs)
        runs.append([i, right[i], top, depth[i], kids[i], ends[i], least[i], -1])
        return len(runs) - 1

    for i in sorted(range(m - 1), key=lambda i: (-lcps[i], i)):
        a, b, d = find(i), i + 1, lcps[i]
        if depth[a] > d:
            pending[a] = [close(a, d)]
            depth[a], kids[a], ends[a] = d, 1, 0
        if depth[b] > d:
            pending[a].append(close(b, d))
            kids[a] += 1
        else:
            ends[a] += ends[b]
        boss[b], right[a], least[a] = a, right[b], min(least[a], least[b])
        pending[b] = []
    close(find(0), -1)
    return runs


def prefix_digests(path: bytes, most: int) -> list[bytes]:
    """Digest of the first 0 to ``most`` turns."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for d in range(most):
        h.update(path[d * WIDTH : (d + 1) * WIDTH])
        out.append(h.copy().digest())
    return out


def block_nodes(rows: list[tuple]) -> dict[str, list]:
    """Columns NODES of a block's trie; ``rows`` are (part, at, conv_id, path, words, before, behind).
    Open nodes, which another block may share, hold this block's part of the sums."""
    ids = [r[2] for r in rows]
    size = np.array([len(r[3]) // WIDTH for r in rows], np.int64)
    before, behind = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
    m = len(rows)
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    sums = np.concatenate([np.concatenate([[0], np.cumsum(np.asarray(r[4], np.int64))]) for r in rows])
    total = sums[offsets[:-1] + size]
    owned = total - sums[offsets[:-1] + np.maximum(before, 0)]  # words of the nodes that begin at a row
    run_total, run_owned = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(owned)])
    run_leaves = np.concatenate([[0], np.cumsum(behind < size)])
    runs = merged_runs(size.tolist(), behind[:-1].tolist(), ids)
    left, right, top, bottom, kids, ends, least, parent = np.array(runs, np.int64).T
    count = bottom - top
    run = np.repeat(np.arange(len(runs)), count)
    depth = top[run] + 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    l, r = left[run], right[run]
    convs = r - l + 1
    above = sums[offsets[l] + np.maximum(depth - 1, 0)]  # words above the node
    children = np.where(depth == bottom[run], kids[run], 1) - ((l == 0) & (before[0] > depth))
    one = total[l] - np.maximum(above, sums[offsets[l] + np.maximum(before[l], 0)])
    saved = run_total[r + 1] - run_total[l] - convs * above - (run_owned[r + 1] - run_owned[l + 1] + one)
    from_left, from_right = (l == 0) & (before[0] >= depth), (r == m - 1) & (behind[-1] >= depth)
    opened = from_left | from_right
    first, last = prefix_digests(rows[0][3], max(int(before[0]), 0)), prefix_digests(rows[-1][3], max(int(behind[-1]), 0))
    # the parent is in the same run, or the bottom node of the run above
    above_run = np.where(depth > top[run] + 1, run, parent[run])
    parent_least = np.where(depth > 0, least[above_run], 0)
    pl, pr = left[above_run], right[above_run]
    parent_left, parent_right = (pl == 0) & (before[0] >= depth - 1), (pr == m - 1) & (behind[-1] >= depth - 1)
    place = (rows[0][0] << 40) + rows[0][1]
    out: dict[str, list] = {
        "open": opened.tolist(), "conv_id": least[run].tolist(), "depth": depth.tolist(), "n_convs": convs.tolist(), "n_children": children.tolist(),
        "n_leaves": (run_leaves[r + 1] - run_leaves[l]).tolist(), "saved_tokens": saved.tolist(),
    }
    parents, shas, nodes, ups, texts = [], [], [], [], []
    n_ends = np.where(depth == bottom[run], ends[run], 0).tolist()
    for i, (is_open, d, a, e) in enumerate(zip(out["open"], out["depth"], l.tolist(), n_ends, strict=True)):
        listed = ",".join(map(str, ids[a : a + e])).encode() if e else b""
        up = None
        if d and (parent_left[i] or parent_right[i]):
            up = first[d - 1] if parent_left[i] else last[d - 1]
        ups.append(up)
        parents.append(int(parent_least[i]) if d and up is None else None)
        nodes.append((first[d] if from_left[i] else last[d]) if is_open else None)
        shas.append(None if is_open else hashlib.sha256(listed).hexdigest() if e else EMPTY_SHA)
        texts.append(listed if is_open and e else None)
    return out | {"parent_conv_id": parents, "ends_sha256": shas, "node": nodes, "parent": ups, "place": [place] * len(run), "ends": texts}


def trie_nodes(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """NODES of all blocks of ``rows`` (SORTED)."""
    edges = boundary_depths(rows)
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in NODES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_pydict(block_nodes(held), schema).to_batches(65_536)

        for batch in batches:
            for part, at, conv_id, path, words, before, behind in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (len(held) >= block_rows or turns >= BLOCK_TURNS or (part, at) != (held[-1][0], held[-1][1] + 1)):
                    yield from blocks()
                    held, turns = [], 0
                before = edges[part][0] if before == UNKNOWN else before
                behind = edges[part][1] if behind == UNKNOWN else behind
                held.append((part, at, conv_id, path, words, before, behind))
                turns += len(words)
        if held:
            yield from blocks()

    return rows.mapInArrow(run, NODES)


def hashed_streams(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of each node's ``ends`` in the order of ``place``, joined by commas.
    A node's digest is sequential by its definition; its parts are sorted by Spark and hashed as they
    come, so nothing of a node is held but the state of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for new, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if new == node:
                    h.update(b",")
                else:
                    if node is not None:
                        done.append((node, h.hexdigest()))
                    node, h = new, hashlib.sha256()
                h.update(ends)
            if done:
                yield pa.RecordBatch.from_pydict({"node": [x[0] for x in done], "ends_sha256": [x[1] for x in done]})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [h.hexdigest()]})

    dealt = parts.repartition(shuffle_count(parts.sparkSession), "node").sortWithinPartitions("node", "place")
    return dealt.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations of ``turns``: conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Null role or text is empty. Turns of one number are ordered by role and a hash of the text, so
    repeated and tied rows have one order. Rows without a conv_id are in no conversation; without
    conversations there is no node, not even the root. Extra columns are not read. A conversation is
    the smallest unit: its turns meet in one task, as 20 bytes each whatever their text.
    """
    spark = turns.sparkSession
    ready = rebuilt(turns.select("conv_id", "turn", "role", "text"))
    dealt = ready.repartitionByRange(shuffle_count(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = cut(dealt.mapInArrow(with_neighbours, SORTED), "trie-rows")
    nodes = cut(trie_nodes(rows, block_rows), "trie-nodes")
    drop_cut(rows)
    opened = nodes.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = opened.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), *sums)
    streams = hashed_streams(opened.where("ends IS NOT NULL").select("node", "place", "ends"))
    merged = cut(merged.join(streams, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))), "trie-merged")
    known = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = nodes.where("NOT open").select(*columns, "parent")
    alone = closed.where("parent IS NULL").drop("parent")
    hung = closed.where("parent IS NOT NULL").drop("parent_conv_id").unionByName(merged.drop("node"))
    joined = hung.join(known, "parent", "left").withColumnRenamed("parent_conv", "parent_conv_id").select(*columns)
    return alone.unionByName(joined).withColumn("depth", F.col("depth").cast("long"))


TRIE_SQL = f"""
WITH {CRC_TABLE_SQL},
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
joined AS (
    SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % {GROUP} WHERE t.pos <= c.h
    UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t USING (conv_id) WHERE t.pos > c.h),
placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
        sha256(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w
    FROM joined),
members AS (
    SELECT conv_id, depth, sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, w FROM placed
    UNION ALL SELECT conv_id, 0, 'root', 0 FROM convs),
linked AS (
    SELECT *, lag(node) OVER steps AS parent, lead(node) OVER steps IS NULL AS ends FROM members WINDOW steps AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
    SELECT node, depth, min(conv_id) AS least, count(*) AS n, any_value(w) AS w, any_value(parent) AS parent,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM linked GROUP BY node, depth),
counted AS (
    SELECT v.*, count(c.node) AS n_children FROM nodes v LEFT JOIN nodes c ON c.parent = v.node GROUP BY ALL),
below AS (
    SELECT m.node, m.conv_id, sum(CASE WHEN v.least = m.conv_id THEN (v.n - 1) * v.w ELSE 0 END) OVER deeper AS saved,
        sum(CASE WHEN v.least = m.conv_id AND v.n_children = 0 THEN 1 ELSE 0 END) OVER deeper AS leaves
    FROM members m JOIN counted v ON v.node = m.node
    WINDOW deeper AS (PARTITION BY m.conv_id ORDER BY m.depth DESC)),
sums AS (SELECT node, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM below GROUP BY node)
SELECT v.least AS conv_id, v.depth, p.least AS parent_conv_id, v.n AS n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM counted v JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = v.parent
"""
