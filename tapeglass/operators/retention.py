"""Retention: tier decisions per market, and which raw rows stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions import scores

# Days that raw prints stay after a market's close, by tier.
TRADE_DAYS = {"observe_only": 1, "sampled": 14, "hot": 30, "triggered": 90, "case": 365}
DAY_US = 86_400_000_000
PRE_NEWS_RELEVANCE = 0.55
PRE_NEWS_PRINTS = 5
PRE_NEWS_SHARE = 0.4


def tier_signals(trades: DataFrame, book: DataFrame, alerts: DataFrame, links: DataFrame, now_us: int) -> DataFrame:
    """(market_pk, severe, price_zscore, burst_score, news_score, pre_news_move, l2_pull_score), one row per
    market that has any of it.

    severe: a critical alert in the day before now. price_zscore: the last price in standard deviations
    from the mean of all. burst_score: prints of the busiest minute over those of the mean minute with
    prints. news_score: the best relevance of a link. pre_news_move: in the day before a relevant link
    at least PRE_NEWS_PRINTS prints of which PRE_NEWS_SHARE of the contracts took one side.
    l2_pull_score: the largest ratio of pulled to added depth (at least 1) of a minute."""
    severe = alerts.where((F.col("severity") == "critical") & (F.col("created_us") > now_us - DAY_US) & (F.col("created_us") <= now_us))
    severe = severe.select("market_pk").distinct().withColumn("severe", F.lit(True))
    spread = F.when(F.stddev_pop("yes_price") > 0, F.stddev_pop("yes_price"))
    prices = trades.groupBy("market_pk").agg((F.abs(F.max_by("yes_price", F.struct("ts_us", "trade_pk")) - F.avg("yes_price")) / spread).alias("price_zscore"))
    minute = F.floor(F.col("ts_us") / 60_000_000)
    bursts = trades.groupBy("market_pk", minute.alias("m")).agg(F.count("*").alias("n")).groupBy("market_pk").agg((F.max("n") / F.avg("n")).alias("burst_score"))
    news = links.groupBy("market_pk").agg(F.max("relevance").alias("news_score"))
    changes = book.where(~F.col("is_snapshot")).groupBy("market_pk", F.floor(F.col("received_us") / 60_000_000).alias("m")).agg(
        F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).cast("double").alias("added"), F.coalesce(-F.sum(F.when(F.col("delta") < 0, F.col("delta"))), F.lit(0)).cast("double").alias("pulled")
    )
    pulls = changes.groupBy("market_pk").agg(F.max(F.col("pulled") / F.greatest("added", F.lit(1.0))).alias("l2_pull_score"))
    out = severe
    for part in (prices, bursts, news, pre_news_moves(trades, links), pulls):
        out = out.join(part, "market_pk", "full")
    return out


def pre_news_moves(trades: DataFrame, links: DataFrame) -> DataFrame:
    """(market_pk, pre_news_move) of markets whose prints leaned to one side in the day before a relevant
    link. Prints and both ends of each link's day are put in one order, so that a day is a difference
    of two running sums and no print meets a link by a join."""
    size = F.col("count").cast("double")
    sided = F.when(F.col("taker_side") == "yes", size).when(F.col("taker_side") == "no", -size).otherwise(0.0)
    points = trades.select("market_pk", F.col("ts_us").alias("at"), F.lit(1).alias("last"), F.lit(1).alias("n"), size.alias("total"), sided.alias("net"), F.lit(None).cast("long").alias("news_id"), F.lit(0).alias("end"))
    relevant = links.where(F.col("relevance") >= PRE_NEWS_RELEVANCE)
    ends = [relevant.select("market_pk", (F.col("news_us") - gap).alias("at"), F.lit(0).alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("net"), F.col("news_id"), F.lit(end).alias("end")) for end, gap in ((-1, DAY_US), (1, 0))]
    rows = points.unionByName(ends[0]).unionByName(ends[1])
    # an end stands before the prints of its own time
    upto = Window.partitionBy("market_pk").orderBy("at", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("market_pk", "news_id", "end", *[F.sum(c).over(upto).alias(c) for c in ("n", "total", "net")]).where("news_id IS NOT NULL")
    days = sums.groupBy("market_pk", "news_id").agg(*[F.sum(F.col("end") * F.col(c)).alias(c) for c in ("n", "total", "net")])
    leaned = (F.col("n") >= PRE_NEWS_PRINTS) & (F.abs("net") >= PRE_NEWS_SHARE * F.col("total"))
    return days.groupBy("market_pk").agg(F.max(leaned).alias("pre_news_move"))


def market_tiers(markets: DataFrame, activity: DataFrame, now_us: int, closing_days: int = 14) -> DataFrame:
    """Retention score, reasons, tier, raw hours and sample rate of every market.

    ``activity``: (market_pk, volume_24h, open_interest, has_alert) and what there is of the columns of
    :func:`tier_signals`, one row per market or none."""
    joined = markets.join(activity, "market_pk", "left")
    closing = (F.col("close_us") > now_us) & (F.col("close_us") <= now_us + closing_days * DAY_US)
    signal = {k: F.col(k) for k in ("severe", "price_zscore", "burst_score", "news_score", "pre_news_move", "l2_pull_score") if k in activity.columns}
    reasons = scores.retention_reasons(F.col("prior"), closing, F.col("volume_24h"), F.col("open_interest"), F.coalesce("has_alert", F.lit(False)), signal)
    scored = joined.withColumn("reasons", reasons).withColumn("score", scores.retention_score(F.col("reasons")))
    return scored.select(
        "market_pk", "prior", "close_us", "reasons", "score",
        scores.storage_tier(F.col("score")).alias("tier"),
        scores.raw_ttl_hours(F.col("score")).alias("ttl_hours"),
        scores.sample_rate(F.col("score")).alias("sample_rate"),
    )


def prune_plan(trades: DataFrame, tiers: DataFrame, flagged: DataFrame, now_us: int) -> DataFrame:
    """(market_pk, trade_pk, tier, pruned): a print goes when its market closed longer ago than its
    tier allows and no flag refers to it."""
    days = F.create_map(*[x for k, v in TRADE_DAYS.items() for x in (F.lit(k), F.lit(v))])
    limit = F.col("close_us") + F.element_at(days, F.col("tier")) * F.lit(DAY_US)
    joined = trades.select("market_pk", "trade_pk").join(tiers.select("market_pk", "tier", "close_us"), "market_pk", "left")
    kept_by_flag = flagged.select("trade_pk").distinct().withColumn("flagged", F.lit(True))
    marked = joined.join(kept_by_flag, "trade_pk", "left")
    return marked.select("market_pk", "trade_pk", "tier", (F.coalesce(limit <= now_us, F.lit(False)) & F.col("flagged").isNull()).alias("pruned"))


def expire(rows: DataFrame, tiers: DataFrame, at: str, now_us: int) -> DataFrame:
    """Raw rows whose tier's hours have not passed; tiers without a limit keep all."""
    joined = rows.join(tiers.select("market_pk", "ttl_hours", "tier"), "market_pk", "left")
    alive = F.col("ttl_hours").isNull() | (F.col(at) + F.col("ttl_hours") * F.lit(3_600_000_000) > now_us)
    return joined.where(alive).select(*rows.columns)


def alert_rollup(alerts: DataFrame) -> DataFrame:
    """Daily summary per market and severity: count, best and mean score, first, last and newest alert."""
    day = F.floor(F.col("created_us") / DAY_US).cast("long")
    return alerts.groupBy("market_pk", day.alias("day"), "severity").agg(
        F.count("*").alias("alerts"),
        F.max("score").alias("max_score"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.min("created_us").alias("first_us"),
        F.max("created_us").alias("last_us"),
        F.max_by("alert_pk", F.struct("created_us", "alert_pk")).alias("latest_pk"),
    )
