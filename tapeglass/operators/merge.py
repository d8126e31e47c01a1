"""Keyed merges: new rows folded into a table column by column, written as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = str


def merged(rule: Rule, old: Column, new: Column, has_old: Column, has_new: Column) -> Column:
    """One column's value after the merge. Rules: replace, keep_old (new only on insert),
    coalesce_new_old, coalesce_old_new, add, greatest, least."""
    if rule == "replace":
        return F.when(has_new, new).otherwise(old)
    if rule == "keep_old":
        return F.when(has_old, old).otherwise(new)
    if rule == "coalesce_new_old":
        return F.coalesce(new, old)
    if rule == "coalesce_old_new":
        return F.coalesce(old, new)
    if rule == "add":
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    if rule in ("greatest", "least"):
        return getattr(F, rule)(old, new)  # both skip nulls
    raise ValueError(f"unknown rule {rule!r}")


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """``target`` with ``updates`` folded in by ``rules``; columns without a rule take replace.

    ``updates`` must have one row per key; use an aggregation or :func:`newest` before. One
    full outer join on the keys, whose null values match one another."""
    old = target.select(*[F.col(c).alias(f"old_{c}") for c in target.columns], F.lit(True).alias("has_old"))
    new = updates.select(*[F.col(c).alias(f"new_{c}") for c in updates.columns], F.lit(True).alias("has_new"))
    same = [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in keys]
    joined = old.join(new, on=same, how="full")
    has_old, has_new = F.coalesce("has_old", F.lit(False)), F.coalesce("has_new", F.lit(False))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.when(has_old, F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c))
        elif c in updates.columns:
            out.append(merged(rules.get(c, "replace"), F.col(f"old_{c}"), F.col(f"new_{c}"), has_old, has_new).alias(c))
        else:
            out.append(F.col(f"old_{c}").alias(c))
    return joined.select(*out)


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, with a partial aggregation before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those new rows whose key it lacks, of several the first by its other columns; a
    replay changes nothing."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else rows.select(*keys).distinct()
    return target.unionByName(one.join(target.select(*keys), keys, "left_anti"))


def row_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(change, rows): how many rows are inserted, changed or unchanged."""
    rest = [c for c in new.columns if c not in keys]
    joined = new.alias("n").join(old.withColumn("there", F.lit(True)).alias("o"), keys, "left")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    change = F.when(F.col("o.there").isNull(), "inserted").when(same, "unchanged").otherwise("changed")
    return joined.groupBy(change.alias("change")).agg(F.count("*").alias("rows"))
