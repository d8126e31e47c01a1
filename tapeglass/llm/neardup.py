"""Near-duplicate vectors by NN-descent.

Vectors that are equal (same label) are one node. A forest of random hyperplanes gives
each node its first neighbours; every round then joins the neighbours of each node with
one another (forward and sampled reverse ones) and keeps each node's best. Links above the
threshold join nodes into components. A list whose every entry is above the threshold is
saturated: it is enlarged to its whole component, which is compared block against block,
so that counts are exact there however large it is. Saturated nodes of different components
are compared in the same way, as their lists have no place for links between dense clusters. An audit compares samples of linked
and of unlinked nodes with all nodes by brute force, and rounds go on until its recall is
reached; where MOST_ROUNDS do not reach it, all nodes of a label are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.llm.common import arrow_map, cut
from tapeglass.llm.components import connected_components
from tapeglass.llm.setjoin import spanning_links

NEIGHBOURS = 8
TREES = 4
LEAF = 192  # nodes that a leaf aims at
BLOCK = 512  # nodes of a leaf or component that are compared at once
HOODS = 48  # neighbourhoods joined in one group
AUDITED = 512  # nodes that the audit samples among the linked ones, and as many among the others
MOST_ROUNDS = 6


def unit(batch_column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    if isinstance(batch_column, pa.ChunkedArray):
        batch_column = batch_column.combine_chunks()
    v = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch_column), -1)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def linkable() -> Column:
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)


def with_node(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, label, embedding); node is null where the vector cannot link."""
    node = F.when(linkable(), F.xxhash64("label", "embedding"))
    return vectors.select("vec_id", "label", "embedding", node.alias("node"))


def forest(nodes: DataFrame, trees: int, neighbours: int, threshold: float) -> DataFrame:
    """(u, v, sim): each node's best neighbours in its leaf of every tree, and a star over the
    nodes that the threshold joins inside the leaf."""
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.log2(F.count("*") / LEAF)).alias("bits"))
    coded = nodes.join(sizes, ["label", "dim"]).select("node", "label", "dim", "embedding", F.greatest("bits", F.lit(0)).cast("int").alias("bits"))

    def make():
        planes: dict[int, np.ndarray] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims = np.array(batch.column("dim").to_pylist())
            bits = np.array(batch.column("bits").to_pylist())
            codes = np.zeros((len(dims), trees), dtype=np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng(20 + int(d)).standard_normal((int(d), trees * 32))
                sign = (unit(batch.column("embedding").take(pa.array(at))) @ planes[d] > 0).reshape(len(at), trees, 32)
                used = np.arange(32)[None, :] < np.minimum(bits[at], 32)[:, None]
                codes[at] = ((sign & used[:, None, :]) << np.arange(32)).sum(axis=2)
            return pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), batch.column("dim"), batch.column("embedding"), pa.array(codes.tolist(), pa.list_(pa.int64()))],
                names=["node", "label", "dim", "embedding", "codes"],
            )

        return work

    schema = f"node long, label {dict(nodes.dtypes)['label']}, dim int, embedding {dict(nodes.dtypes)['embedding']}, codes array<long>"
    leaves = arrow_map(coded, make, schema).select("node", "label", "dim", "embedding", F.posexplode("codes").alias("tree", "code"))
    leaf = ["tree", "label", "dim", "code"]
    counts = leaves.groupBy(*leaf).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = leaves.join(counts, leaf).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))

    def best(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        v = unit(table.column("embedding"))
        s = v @ v.T
        np.fill_diagonal(s, -2.0)
        k = min(neighbours, len(node) - 1)
        if k < 1:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        u, w = np.repeat(np.arange(len(node)), k), top.ravel()
        # a star per cluster: every node of it hangs on its first member above the threshold
        above = s >= threshold
        has = np.flatnonzero(above.any(axis=1))
        first = above[has].argmax(axis=1)
        u, w = np.concatenate([u, has]), np.concatenate([w, first])
        return pa.table({"u": node[u], "v": node[w], "sim": s[u, w]})

    return dealt.groupBy(*leaf, "part").applyInArrow(best, "u long, v long, sim double")


def keep_best(edges: DataFrame, neighbours: int) -> DataFrame:
    """Each node's best distinct neighbours, with the least similarity of its list if the list is full."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("rank", rank).where(F.col("rank") <= neighbours).drop("rank")


def descend(nodes: DataFrame, graph: DataFrame, neighbours: int, round_no: int) -> DataFrame:
    """(u, v, sim) that are better than what ``graph`` holds: neighbours of a node joined with one another."""
    degree = graph.groupBy(F.col("v").alias("hood")).agg(F.count("*").alias("degree"))
    reverse = graph.select(F.col("v").alias("hood"), F.col("u").alias("node")).join(degree, "hood")
    draw = F.pmod(F.xxhash64("hood", "node", F.lit(round_no)), F.lit(1 << 20)) * F.col("degree") < (1 << 20) * 2 * neighbours
    hoods = (
        graph.select(F.col("u").alias("hood"), F.col("v").alias("node"))
        .unionByName(reverse.where(draw).select("hood", "node"))
        .unionByName(nodes.select(F.col("node").alias("hood"), "node"))
        .distinct()
    )
    worst = graph.groupBy(F.col("u").alias("node")).agg(F.min("sim").alias("least"), F.count("*").alias("held"))
    worst = worst.select("node", F.when(F.col("held") >= neighbours, F.col("least")).otherwise(F.lit(-2.0)).alias("least"))
    carried = nodes.select("node", "embedding").join(worst, "node", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    groups = max(1, nodes.count() // HOODS)
    dealt = hoods.join(carried, "node").withColumn("grp", F.pmod(F.xxhash64("hood", F.lit(7)), F.lit(groups)))

    def join(table: pa.Table) -> pa.Table:
        hood, node, least = (table.column(c).to_numpy() for c in ("hood", "node", "least"))
        sizes = pc.list_value_length(table.column("embedding")).to_numpy()
        out_u, out_v, out_s = [], [], []
        order = np.lexsort((sizes, hood))
        cuts = np.flatnonzero((np.diff(hood[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1
        for at in np.split(order, cuts):
            if len(at) < 2:
                continue
            v = unit(table.column("embedding").take(pa.array(at)))
            s = v @ v.T
            np.fill_diagonal(s, -3.0)
            i, j = np.nonzero(s > least[at][:, None])
            out_u.append(node[at][i])
            out_v.append(node[at][j])
            out_s.append(s[i, j])
        if not out_u:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        u, w, s = np.concatenate(out_u), np.concatenate(out_v), np.concatenate(out_s)
        _, first = np.unique(np.stack([u, w]), axis=1, return_index=True)
        return pa.table({"u": u[first], "v": w[first], "sim": s[first]})

    return dealt.groupBy("grp").applyInArrow(join, "u long, v long, sim double")


def enlarge(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(node, linked, near): how many vectors, and how many nodes, every node of a component
    links to inside it, by comparing the component's blocks in pairs."""
    members = nodes.join(roots, "node").select("node", "root", "embedding", "copies")
    parts = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "node", "embedding", "copies"
    )

    def count(table: pa.Table) -> pa.Table:
        node, part, copies = (table.column(c).to_numpy() for c in ("node", "part", "copies"))
        v = unit(table.column("embedding"))
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        near = v @ v.T >= threshold
        np.fill_diagonal(near, False)
        if x != y:
            near &= part[:, None] != part[None, :]
        return pa.table({"node": node, "linked": near @ copies, "near": near.sum(axis=1)})

    found = pairs.groupBy("root", "x", "y").applyInArrow(count, "node long, linked long, near long")
    return found.groupBy("node").agg(F.sum("linked").alias("linked"), F.sum("near").alias("near"))


def joining_links(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between nodes of different components (column root), as few as join what
    all of them join. All members of a label are compared, block against block."""
    group = ["label", "dim"]
    parts = members.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.min("root").alias("p"), F.max("root").alias("q"))
    dealt = members.join(parts.where("p < q"), group).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *group, F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "node", "root", "embedding"
    )

    def compare(table: pa.Table) -> pa.Table:
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        v = unit(table.column("embedding"))
        found = spanning_links((v @ v.T >= threshold) & (root[:, None] != root[None, :]))
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    return pairs.groupBy(*group, "x", "y").applyInArrow(compare, "a long, b long")


def with_root(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "label", "dim", "embedding")


def saturated(graph: DataFrame, neighbours: int, threshold: float) -> DataFrame:
    """(node): nodes whose list is full of links."""
    held = graph.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("held"), F.min("sim").alias("least"))
    return held.where((F.col("held") >= neighbours) & (F.col("least") >= threshold)).select("node")


def audit(nodes: DataFrame, linked: DataFrame, threshold: float) -> float:
    """Mean share of its links that a node with links has found, the least over classes of nodes
    by how many links they have. Copies do not count. AUDITED nodes among the linked ones
    and AUDITED among the others are compared with all nodes; each stands for its share."""
    spark = nodes.sparkSession
    known = nodes.join(linked.select("node", "near"), "node", "left").withColumn("near", F.coalesce("near", F.lit(0)))
    drawn, facts = [], {}
    for part in (known.where("near > 0"), known.where("near = 0")):
        size = part.count()
        some = part.orderBy(F.xxhash64("node", F.lit("audit"))).limit(AUDITED).select("node", "label", "embedding", "near").collect()
        facts |= {r["node"]: (r["near"], size / len(some)) for r in some}
        drawn += some
    by: dict[tuple, tuple[list, list]] = {}
    for r in drawn:
        ids, vectors = by.setdefault((r["label"], len(r["embedding"])), ([], []))
        ids.append(r["node"])
        vectors.append(r["embedding"])
    shared = spark.sparkContext.broadcast({k: (np.array(i), unit(pa.array(v))) for k, (i, v) in by.items()})

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            node = batch.column("node").to_numpy()
            ids, counts = [], []
            for key, (query, q) in shared.value.items():
                at = np.flatnonzero([(x, d) == key for x, d in zip(labels, dims, strict=True)])
                if len(at):
                    near = unit(batch.column("embedding").take(pa.array(at))) @ q.T >= threshold
                    near &= node[at][:, None] != query[None, :]
                    ids.append(query)
                    counts.append(near.sum(axis=0))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["node", "there"]
            )

        return work

    there = arrow_map(nodes.select("node", "label", "dim", "embedding"), make, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    shares: dict[int, list[tuple[float, float]]] = {}
    for r in there.where("there > 0").collect():  # one row for each sampled node
        near, weight = facts[r["node"]]
        shares.setdefault((r["there"].bit_length() - 1) // 3, []).append((weight, weight * min(1.0, near / r["there"])))
    return min((sum(x for _, x in of) / sum(w for w, _ in of) for of in shares.values()), default=1.0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, target_recall: float = 0.97) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when labels are equal and not null and the cosine of the embeddings, in
    double precision, reaches ``threshold``; embeddings of different lengths never link. A
    vector that is null, empty, zero or holds a null or non-finite component links with
    nothing: 0 links, its own component, kept. Repeated rows are copies of one another and
    count as links. A null vec_id takes part in links; a component's id is its smallest
    non-null vec_id. Empty tables give no rows; extra columns are not read.
    """
    rows = with_node(vectors)
    nodes = cut(
        rows.where("node IS NOT NULL").groupBy("node", "label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("embedding")),
        "near-nodes",
    )
    seeds = cut(forest(nodes, TREES, NEIGHBOURS, threshold), "near-forest")
    graph = cut(keep_best(seeds, NEIGHBOURS), "near-graph")
    links = seeds.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    for round_no in range(1, MOST_ROUNDS + 1):
        better = cut(descend(nodes, graph, NEIGHBOURS, round_no), "near-better")
        graph = cut(keep_best(graph.unionByName(better), NEIGHBOURS), "near-graph")
        links = links.unionByName(better.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
        links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
        roots = cut(connected_components(links), "near-roots")
        full = saturated(graph, NEIGHBOURS, threshold)
        more = cut(joining_links(with_root(nodes.join(full, "node", "left_semi"), roots), threshold), "near-more")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = cut(connected_components(links), "near-roots")
        linked = cut(enlarge(nodes, roots, threshold), "near-linked")
        if audit(nodes, linked, threshold) >= target_recall:
            break
    else:
        more = cut(joining_links(with_root(nodes, roots), threshold), "near-more")
        roots = cut(connected_components(links.unionByName(more)), "near-roots")
        linked = cut(enlarge(nodes, roots, threshold), "near-linked")
    rooted = nodes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    facts = cut(
        rooted.join(smallest, "root").join(linked, "node", "left")
        .select("node", "component", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links")),
        "near-facts",
    )
    return rows.select("vec_id", "node").join(facts, "node", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


# The same rows as SQL: every pair compared, components by repeated minima.
NEAR_SQL = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v
)
SELECT e.vec_id, coalesce(n.c, 0) AS n_links, m.r AS component_id, e.vec_id = m.r AS kept
FROM embeddings e
JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) m ON m.v = e.vec_id
LEFT JOIN (SELECT a, count(*) AS c FROM links GROUP BY a) n ON n.a = e.vec_id
"""
