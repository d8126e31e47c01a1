"""Aggregations over markets: baselines, counters, breakdowns, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peer_baselines(prints: DataFrame, least_points: int = 12) -> DataFrame:
    """Per (category, subcategory) and per (category, '*'): size percentiles and the 95th of price
    moves between successive prints of a market; scopes with fewer than ``least_points`` sizes are
    left out. A null subcategory belongs to '*' once.

    Moves are made once per market. Equal values are counted before the scopes are formed, and
    percentiles (linear interpolation) come from running counts in value order, so that no task
    holds the values of a scope in memory."""
    category, sub = F.coalesce("category", F.lit("unclassified")), F.coalesce("subcategory", F.lit("*"))
    order = Window.partitionBy("market_pk").orderBy("ts_us", "trade_pk").rowsBetween(Window.unboundedPreceding, -1)
    moved = prints.select(
        category.alias("category"), sub.alias("subcategory"), F.when(F.col("count") > 0, F.col("count").cast("double")).alias("size"),
        F.abs(F.col("yes_price") - F.last("yes_price", ignorenulls=True).over(order)).alias("move"),
    )
    each = moved.select("category", "subcategory", F.explode(F.array(F.struct(F.lit("size").alias("kind"), F.col("size").alias("value")), F.struct(F.lit("move").alias("kind"), F.col("move").alias("value")))).alias("v"))
    counted = each.where("v.value IS NOT NULL").groupBy("category", "subcategory", "v.kind", "v.value").agg(F.count("*").alias("n"))
    scopes = F.explode(F.array_distinct(F.array("subcategory", F.lit("*"))))
    keys = ["category", "subcategory", "kind"]
    scoped = counted.withColumn("subcategory", scopes).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = scoped.withColumn("upto", running).join(scoped.groupBy(*keys).agg(F.sum("n").alias("total")), keys)

    def percentile(kind: str, share: float) -> Column:
        at = (F.col("total") - 1) * F.lit(share)
        low, high = (F.min(F.when((F.col("kind") == kind) & (F.col("upto") > edge), F.col("value"))) for edge in (F.floor(at), F.ceil(at)))
        part = F.max(F.when(F.col("kind") == kind, at - F.floor(at)))
        return low + (high - low) * part

    found = placed.groupBy("category", "subcategory").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "size", F.col("total"))), F.lit(0)).alias("sample_size"),
        percentile("size", 0.95).alias("count_p95"),
        percentile("size", 0.99).alias("count_p99"),
        F.coalesce(percentile("move", 0.95), F.lit(0.0)).alias("move_p95"),
    )
    return found.where(F.col("sample_size") >= least_points)


def trade_stats(trades: DataFrame) -> DataFrame:
    """Per market: prints, first and last time, price range, contracts and dollars."""
    return trades.groupBy("market_pk").agg(
        F.count("*").alias("trade_count"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min("yes_price").alias("min_price"),
        F.max("yes_price").alias("max_price"),
        F.sum("count").cast("double").alias("contracts"),
        F.sum(F.coalesce(F.col("count") * F.col("yes_price").cast("decimal(8,4)"), F.lit(0))).cast("double").alias("dollars"),
    )


def latest_per_market(quotes: DataFrame) -> DataFrame:
    """The newest quote of each market; of several at one instant the one with the highest key."""
    newest = F.max_by(F.struct("quote_pk", "ts_us", "yes_bid", "yes_ask", "last_price"), F.struct("ts_us", "quote_pk"))
    return quotes.groupBy("market_pk").agg(newest.alias("q")).select("market_pk", "q.*")


def book_activity(book: DataFrame, now_us: int, minutes: int = 3) -> DataFrame:
    """Book events of the last ``minutes`` per market: counts, pulled size, and the two flags with
    the points they add to an alert score."""
    recent = book.where(F.col("received_us").between(now_us - minutes * 60_000_000, now_us))
    change = ~F.col("is_snapshot")
    pulled = F.coalesce(-F.sum(F.when(change & (F.col("delta") < 0), F.col("delta"))), F.lit(0))
    sums = recent.groupBy("market_pk").agg(F.count("*").alias("book_events"), F.count_if(change).alias("book_deltas"), pulled.cast("double").alias("pull_volume"))
    churn, cancel = F.col("book_events") > 400, (F.col("pull_volume") > 75) & (F.col("book_deltas") > 30)
    points = F.when(churn, 1.5).otherwise(0.0) + F.when(cancel, 2.0).otherwise(0.0)
    return sums.select("*", churn.alias("high_churn"), cancel.alias("heavy_cancel"), points.alias("book_points"))


def breakdowns(markets: DataFrame) -> DataFrame:
    """Market counts by category, by prior and by both, in one pass; nulls count as unclassified."""
    known = markets.select(*[F.coalesce(c, F.lit("unclassified")).alias(c) for c in ("category", "prior")])
    grouped = known.groupingSets([["category"], ["prior"], ["category", "prior"]], "category", "prior")
    kind = F.when(F.grouping_id() == 1, "category").when(F.grouping_id() == 2, "prior").otherwise("category_prior")
    return grouped.agg(kind.alias("kind"), F.count("*").alias("markets")).select("kind", "category", "prior", "markets")


def top_markets(trades: DataFrame, markets: DataFrame, limit: int = 50) -> DataFrame:
    """The most traded markets with their dollars; ties by market. A report of ``limit`` rows."""
    stats = trade_stats(trades).select("market_pk", "trade_count", "dollars", "last_us")
    named = stats.join(markets.select("market_pk", "market_id", "category", "prior"), "market_pk", "left")
    return named.orderBy(F.desc("trade_count"), "market_pk").limit(limit)
