"""Price bars: quotes and prints bucketed into mergeable rows, and bars merged into wider ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeglass.functions.scores import bucket_start

TRADE_RANK, LAST_RANK, MIDPOINT_RANK = 3, 2, 1
PRICE_TYPE, SIZE_TYPE = "double", "decimal(18,2)"


def quote_points(quotes: DataFrame) -> DataFrame:
    """Quotes as one-row bars without a bucket; quotes with no price and no side are dropped."""
    price = F.coalesce("last_price", (F.col("yes_bid") + F.col("yes_ask")) / 2)
    rank = F.when(F.col("last_price").isNotNull(), LAST_RANK).when(price.isNotNull(), MIDPOINT_RANK).otherwise(0)
    seen = quotes.where("last_price IS NOT NULL OR yes_bid IS NOT NULL OR yes_ask IS NOT NULL")
    return as_bars(seen, price, rank, F.col("yes_bid"), F.col("yes_ask"), F.col("volume"), quote=True)


def trade_points(trades: DataFrame) -> DataFrame:
    """Prints with a price as one-row bars."""
    none = F.lit(None)
    return as_bars(trades.where("yes_price IS NOT NULL"), F.col("yes_price"), F.lit(TRADE_RANK), none, none, none, quote=False)


def as_bars(rows: DataFrame, price: Column, rank: Column, bid: Column, ask: Column, volume: Column, quote: bool) -> DataFrame:
    priced = F.when(price.isNotNull(), F.col("ts_us"))
    quoted = F.col("ts_us") if quote else F.lit(None)
    traded = F.lit(0) if quote else F.coalesce(F.col("count"), F.lit(0))
    columns = {
        **{f"{k}_price": price.cast(PRICE_TYPE) for k in ("open", "high", "low", "close")},
        "close_rank": rank.cast("int"),
        "open_rank": rank.cast("int"),
        "first_price_us": priced,
        "last_price_us": priced,
        **{f"{k}_bid": bid.cast(PRICE_TYPE) for k in ("open", "high", "low", "close")},
        **{f"{k}_ask": ask.cast(PRICE_TYPE) for k in ("open", "high", "low", "close")},
        "close_volume": volume.cast(SIZE_TYPE),
        "close_volume_us": F.when(volume.isNotNull(), F.col("ts_us")),
        "first_quote_us": quoted.cast("long"),
        "last_quote_us": quoted.cast("long"),
        "trade_count": F.lit(0 if quote else 1).cast("long"),
        "trade_volume": traded.cast(SIZE_TYPE),
        "quote_count": F.lit(1 if quote else 0).cast("long"),
    }
    return rows.select("market_pk", F.col("ts_us").alias("at_us"), *[c.alias(n) for n, c in columns.items()])


def merge_bars(bars: DataFrame, interval_sec: int) -> DataFrame:
    """One bar per market and bucket of ``interval_sec``.

    Open comes from the earliest price (of several at one instant, the strongest source), close from the strongest source and then the
    latest; each closing quote field is its latest value that is not null. All of it is
    associative, so the map side combines and bars of bars equal bars of points."""
    keyed = bars.withColumn("bucket", bucket_start(F.col("at_us"), interval_sec))
    opening = F.when(F.col("first_price_us").isNotNull(), F.struct(F.col("first_price_us"), -F.col("open_rank")))

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_quote_us"))).alias(c)

    out = [
        F.min_by("open_price", opening).alias("open_price"),
        F.min_by("open_rank", opening).alias("open_rank"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", F.when(F.col("close_price").isNotNull(), F.struct("close_rank", "last_price_us"))).alias("close_price"),
        F.max(F.when(F.col("close_price").isNotNull(), F.col("close_rank"))).alias("close_rank"),
        F.min("first_price_us").alias("first_price_us"),
        F.max("last_price_us").alias("last_price_us"),
    ]
    for side in ("bid", "ask"):
        out += [
            F.min_by(f"open_{side}", "first_quote_us").alias(f"open_{side}"),
            F.max(f"high_{side}").alias(f"high_{side}"),
            F.min(f"low_{side}").alias(f"low_{side}"),
            latest(f"close_{side}"),
        ]
    out += [
        F.max_by("close_volume", "close_volume_us").alias("close_volume"),
        F.max("close_volume_us").alias("close_volume_us"),
        F.min("first_quote_us").alias("first_quote_us"),
        F.max("last_quote_us").alias("last_quote_us"),
        F.sum("trade_count").alias("trade_count"),
        F.sum("trade_volume").cast(SIZE_TYPE).alias("trade_volume"),
        F.sum("quote_count").alias("quote_count"),
    ]
    return keyed.groupBy("market_pk", "bucket").agg(*out).withColumn("at_us", F.col("bucket") * 1_000_000)


def price_bars(trades: DataFrame, quotes: DataFrame, interval_sec: int = 300) -> DataFrame:
    return merge_bars(trade_points(trades).unionByName(quote_points(quotes)), interval_sec)


def side_volume(trades: DataFrame, interval_sec: int) -> DataFrame:
    """Contracts per market and bucket, split by taker side; prints without a side count as other."""
    side = F.coalesce(F.col("taker_side"), F.lit("other"))
    return (
        trades.groupBy("market_pk", bucket_start(F.col("ts_us"), interval_sec).alias("bucket"))
        .agg(*[F.coalesce(F.sum(F.when(side == s, F.col("count"))), F.lit(0)).cast("double").alias(f"{s}_volume") for s in ("yes", "no", "other")])
    )


def minute_features(trades: DataFrame, quotes: DataFrame, book: DataFrame) -> DataFrame:
    """Per market and minute: prints, quotes and book changes; depth_pull_score is the cancelled
    share of all size added or cancelled, 0 without any."""
    minute = 60
    prints = trades.select("market_pk", bucket_start(F.col("ts_us"), minute).alias("bucket"), "ts_us", "count", "yes_price").groupBy("market_pk", "bucket").agg(
        F.count("*").alias("trade_count"), F.sum("count").alias("volume"), F.max("count").alias("max_size"),
        F.min_by("yes_price", "ts_us").alias("first_price"), F.max_by("yes_price", "ts_us").alias("last_price"),
        F.min("yes_price").alias("min_price"), F.max("yes_price").alias("max_price"),
    )
    seen = quotes.groupBy("market_pk", bucket_start(F.col("ts_us"), minute).alias("bucket")).agg(
        F.count("*").alias("quote_updates"), F.max(F.col("yes_ask") - F.col("yes_bid")).alias("max_spread")
    )
    changes = book.where("NOT is_snapshot").groupBy("market_pk", bucket_start(F.col("received_us"), minute).alias("bucket")).agg(
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).alias("added"),
        F.coalesce(-F.sum(F.when(F.col("delta") < 0, F.col("delta"))), F.lit(0)).alias("cancelled"),
    )
    joined = prints.join(seen, ["market_pk", "bucket"], "full").join(changes, ["market_pk", "bucket"], "full")
    moved = F.coalesce(F.col("added") + F.col("cancelled"), F.lit(0))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("trade_count", "quote_updates")}
    size = {c: F.coalesce(c, F.lit(0)).cast("double") for c in ("volume", "max_size", "added", "cancelled")}
    pull = F.when(moved > 0, F.col("cancelled").cast("double") / moved.cast("double")).otherwise(0.0)
    return joined.withColumns({**zero, **size, "depth_pull_score": pull})


def compact(fine: DataFrame, closed: DataFrame, from_sec: int, to_sec: int) -> tuple[DataFrame, DataFrame]:
    """(new, kept): the bars of closed markets merged to ``to_sec``, and the fine bars that stay. Both
    must be written together, as a bar in both would count twice."""
    if to_sec % from_sec:
        raise ValueError(f"{to_sec} is no multiple of {from_sec}")
    keys = closed.select("market_pk").distinct()
    return merge_bars(fine.join(keys, "market_pk", "left_semi"), to_sec), fine.join(keys, "market_pk", "left_anti")
