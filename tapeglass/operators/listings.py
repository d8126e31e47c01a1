"""Listings and unions: market lists, event groups, series merges, fallbacks, prune plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sort modes of the market list: columns and directions, nulls last.
SORTS: dict[str, list[tuple[str, bool]]] = {
    "trades": [("trade_count", True)],
    "trades_asc": [("trade_count", False)],
    "urgency": [("urgency", True), ("trade_count", True)],
    "top_flag": [("top_flag", True)],
    "recent": [("last_us", True)],
    "title": [("market_id", False)],
    "priority": [("priority", True), ("trade_count", True)],
    "news_flag": [("top_news", True), ("top_flag", True)],
    "alerts": [("high_alerts", True), ("alerts", True)],
}


def market_list(markets: DataFrame, stats: DataFrame, flags: DataFrame, sort: str, limit: int) -> DataFrame:
    """Markets with their counters and best flag in one of the SORTS, ties by market; ``limit`` rows."""
    best = flags.groupBy("market_pk").agg(F.max("score").alias("top_flag"), F.count("*").alias("flags"))
    joined = markets.join(stats, "market_pk", "left").join(best, "market_pk", "left").fillna(0, ["trade_count", "flags"])
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in SORTS[sort]]
    return joined.orderBy(*order, "market_pk").limit(limit)


def event_groups(markets: DataFrame) -> DataFrame:
    """Every market with its place in its event by close time (null first) and the event's size."""
    order = Window.partitionBy("event_id").orderBy(F.asc_nulls_first("close_us"), "market_pk")
    size = markets.groupBy("event_id").agg(F.count("*").alias("event_size"))
    return markets.withColumn("place", F.row_number().over(order)).join(size, "event_id").select("market_pk", "event_id", "close_us", "place", "event_size")


def link_prints(links: DataFrame, trades: DataFrame, lookback_us: int, most: int | None = 1000) -> DataFrame:
    """The earliest ``most`` prints of each link's market in the lookback before its news (an
    explicit limit of the report), or with None all of them. Joined on market and time block."""
    block = F.floor(F.col("news_us") / lookback_us)
    wide = links.withColumn("block", F.explode(F.array(block, block - 1)))
    prints = trades.withColumn("block", F.floor(F.col("ts_us") / lookback_us))
    met = wide.join(prints, ["market_pk", "block"]).where((F.col("ts_us") < F.col("news_us")) & (F.col("ts_us") >= F.col("news_us") - lookback_us))
    if most is None:
        return met.drop("block")
    place = F.row_number().over(Window.partitionBy("news_id").orderBy("ts_us", "trade_pk"))
    return met.withColumn("place", place).where(F.col("place") <= most).drop("block")


def first_known(keys: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Each key with the first source that knows a value for it, and that source's name."""
    joined = keys
    for name, rows in sources:
        joined = joined.join(rows.select(key, F.col(value).alias(f"from_{name}")), key, "left")
    found = [F.when(F.col(f"from_{name}").isNotNull(), F.lit(name)) for name, _ in sources]
    return joined.select(key, F.coalesce(*[f"from_{name}" for name, _ in sources]).alias(value), F.coalesce(*found).alias("source"))


def merge_series(parts: list[tuple[int, DataFrame]], keys: list[str], value: str) -> DataFrame:
    """One row per key: the value of the part with the lowest rank."""
    rows = None
    for rank, part in parts:
        ranked = part.select(*keys, F.col(value), F.lit(rank).alias("rank"))
        rows = ranked if rows is None else rows.unionByName(ranked)
    return rows.groupBy(*keys).agg(F.min_by(value, "rank").alias(value), F.min("rank").alias("rank"))


def covered_quotes(quotes: DataFrame, bars: DataFrame, interval_sec: int, referenced: DataFrame, before_us: Column) -> DataFrame:
    """(market_pk, quote_pk) of quotes that can go: older than ``before_us``, not the market's newest,
    referred to by nothing, and covered by a bar of their bucket."""
    bucket = (F.floor(F.col("ts_us") / F.lit(interval_sec * 1_000_000)) * interval_sec).cast("long")
    newest = quotes.groupBy("market_pk").agg(F.max(F.struct("ts_us", "quote_pk")).alias("n")).select("market_pk", F.col("n.quote_pk").alias("newest_pk"))
    old = quotes.where(F.col("ts_us") < before_us).withColumn("bucket", bucket)
    kept = bars.where("quote_count > 0").select("market_pk", "bucket")
    left = old.join(kept, ["market_pk", "bucket"], "left_semi").join(referenced.select("quote_pk"), "quote_pk", "left_anti")
    return left.join(newest, "market_pk").where("quote_pk <> newest_pk").select("market_pk", "quote_pk")
