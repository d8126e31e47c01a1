"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.sources.storage import Scratch


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) join to another; root is the smallest of its
    component.

    Components are contracted: a round hangs each node on its smallest neighbour, follows these
    parents until they end, and replaces the ends of links by their roots; links inside a root
    go. At least half of the nodes with links vanish in a round. Rounds are settled in the shared
    folder. Nodes with very many links are counted up before they are shuffled, and joins by them
    are inner or left joins that Spark splits."""
    work = Scratch(links.sparkSession)
    live = work.settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = work.settle(ends.select("node", F.col("node").alias("root")))
    while not live.isEmpty():
        parents = work.settle(followed(work, live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))))
        roots, old = work.settle(replaced(roots, "root", parents)), roots
        moved = replaced(replaced(live, "a", parents), "b", parents).where("a <> b")
        live, past = work.settle(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), live
        work.free(old, past, parents)
    return roots


def replaced(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its parent, where it has one."""
    known = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    joined = rows.join(known, F.col(column) == F.col("_node"), "left")
    return joined.select(*[F.coalesce("_parent", column).alias(column) if c == column else F.col(c) for c in rows.columns])


def followed(work: Scratch, parents: DataFrame) -> DataFrame:
    """``parents`` (node, parent) with each parent replaced by the last of its chain; parents are smaller
    than their nodes, so chains end, and a step is doubled each time."""
    steps = work.settle(parents)
    while True:
        longer = work.settle(replaced(steps, "parent", steps))
        same = steps.join(longer, ["node", "parent"], "left_anti").isEmpty()
        work.free(steps)
        steps = longer
        if same:
            return steps
