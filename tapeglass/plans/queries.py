"""Queries over whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.functions import scores
from tapeglass.operators import alerts as alerting
from tapeglass.operators import bars, classify, folds, listings, merge, news, retention, stats, tape, timejoin
from tapeglass.sources import adapters as src

BAR_COLUMNS = [
    "market_pk", "bucket", "open_price", "high_price", "low_price", "close_price", "close_rank", "open_bid", "high_bid", "low_bid", "close_bid",
    "open_ask", "high_ask", "low_ask", "close_ask", "first_price_us", "last_price_us", "first_quote_us", "last_quote_us", "trade_count", "quote_count",
]


def shown(found: DataFrame) -> DataFrame:
    return found.select(*BAR_COLUMNS, F.col("trade_volume").cast("double").alias("trade_volume"), F.col("close_volume").cast("double").alias("close_volume"))


def price_bars(spark: SparkSession, d: str) -> DataFrame:
    return shown(bars.price_bars(src.trades(spark, d), src.quotes(spark, d), 300))


def hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    return shown(bars.merge_bars(bars.price_bars(src.trades(spark, d), src.quotes(spark, d), 300), 3600))


def side_volume(spark: SparkSession, d: str) -> DataFrame:
    return bars.side_volume(src.trades(spark, d), 300)


def minute_features(spark: SparkSession, d: str) -> DataFrame:
    found = bars.minute_features(src.trades(spark, d), src.quotes(spark, d), src.book_events(spark, d))
    return found.withColumn("depth_pull_score", F.round("depth_pull_score", 9)).withColumn("max_spread", F.round("max_spread", 9))


def tape_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = tape.score_prints(src.trades(spark, d))
    rounded = {c: F.round(c, 3) for c in ("size_z", "move_z", "raw_move", "cluster")}
    return scored.withColumns(rounded).select(
        "market_pk", "trade_pk", "score", *rounded, "dollars", "multiplier", F.concat_ws(",", "reasons").alias("reasons")
    )


def tape_bursts(spark: SparkSession, d: str) -> DataFrame:
    return tape.burst_prints(src.trades(spark, d)).select("market_pk", "trade_pk", "window_count", "yes_count", "no_count", "cluster_score")


def burst_summary(spark: SparkSession, d: str) -> DataFrame:
    return tape.burst_summary(tape.burst_prints(src.trades(spark, d)))


def quote_asof(spark: SparkSession, d: str) -> DataFrame:
    found = timejoin.quote_at_or_before(src.trades(spark, d), src.quotes(spark, d), ["yes_bid", "yes_ask"])
    return found.select("market_pk", "trade_pk", "quote_us", "yes_bid", "yes_ask")


def follow_through(spark: SparkSession, d: str) -> DataFrame:
    found = timejoin.follow_through(src.trades(spark, d), 300_000_000)
    return found.select("market_pk", "trade_pk", "later_price", F.round(F.col("later_price") - F.col("yes_price"), 9).alias("move"))


def news_links(spark: SparkSession, d: str) -> DataFrame:
    markets = src.read(spark, d, "events").agg(F.max("user_id") + 1).scalar()
    return src.articles(spark, d).select(
        F.col("article_id").alias("news_id"),
        (F.col("article_id") % markets).alias("market_pk"),
        F.col("first_seen_us").alias("news_us"),
        ((F.col("article_id") * 37 % 100) / 100).alias("relevance"),
    )


def news_after(spark: SparkSession, d: str) -> DataFrame:
    found = timejoin.news_within(src.trades(spark, d), news_links(spark, d), 72, 0.45, after=True)
    return found.select("market_pk", "trade_pk", "news_id", F.round("hours_apart", 6).alias("hours_apart"))


def news_before(spark: SparkSession, d: str) -> DataFrame:
    found = timejoin.news_within(src.trades(spark, d), news_links(spark, d), 24, 0.55, after=False)
    return found.select("market_pk", "trade_pk", "news_id", F.round("hours_apart", 6).alias("hours_apart"))


def peer_baselines(spark: SparkSession, d: str) -> DataFrame:
    markets = src.markets(spark, d).select("market_pk", "category", F.col("event_id").alias("subcategory"))
    found = stats.peer_baselines(src.trades(spark, d).join(markets, "market_pk", "left"))
    return found.select("category", "subcategory", "sample_size", *[F.round(c, 6).alias(c) for c in ("count_p95", "count_p99", "move_p95")])


def trade_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.trade_stats(src.trades(spark, d))


def latest_quotes(spark: SparkSession, d: str) -> DataFrame:
    return stats.latest_per_market(src.quotes(spark, d))


def book_activity(spark: SparkSession, d: str) -> DataFrame:
    return stats.book_activity(src.book_events(spark, d), src.ORIGIN_US + 1_800_000_000, minutes=3)


def market_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    return stats.breakdowns(src.markets(spark, d))


def top_markets(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_markets(src.trades(spark, d), src.markets(spark, d), 50)


def market_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    dated = F.concat(F.lit("KXEVENT-"), F.date_format(F.timestamp_micros("close_us"), "yyMMMdd"), F.lit("-"), F.col("market_pk").cast("string"))
    market_id = F.when(F.col("market_pk") % 3 == 0, F.upper(dated)).otherwise(F.col("market_id"))
    named = src.markets(spark, d).withColumn("market_id", market_id)
    stale = scores.stale_event(F.col("market_id"), src.NOW_US)
    label = scores.lifecycle(F.col("status"), F.col("close_us"), stale, src.NOW_US)
    return named.select("market_pk", "market_id", stale.alias("stale"), label.alias("lifecycle"), scores.in_scope(F.col("category"), F.col("prior")).alias("in_scope"))


def market_scores(spark: SparkSession, d: str) -> DataFrame:
    counts = src.trades(spark, d).groupBy("market_pk").agg(F.count("*").alias("n"))
    joined = src.markets(spark, d).join(counts, "market_pk", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = scores.prior_rank(F.col("prior"))
    return joined.select("market_pk", rank.alias("rank"), scores.evidence_score(F.col("n")).alias("evidence"), scores.urgency_score(rank, F.col("n")).alias("urgency"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    prints = src.trades(spark, d)
    sums = prints.groupBy("market_pk").agg(
        F.sum("count").alias("volume_24h"), F.sum(F.when(F.col("taker_side") == "yes", F.col("count"))).alias("open_interest"), (F.max("count") > 90).alias("has_alert")
    )
    return sums.join(retention.tier_signals(prints, src.book_events(spark, d), alerts(spark, d), news_links(spark, d), src.NOW_US), "market_pk", "full")


def tiers(spark: SparkSession, d: str) -> DataFrame:
    return retention.market_tiers(src.markets(spark, d), activity(spark, d), src.NOW_US)


def retention_tiers(spark: SparkSession, d: str) -> DataFrame:
    return tiers(spark, d).select("market_pk", "score", "tier", "ttl_hours", "sample_rate", F.concat_ws(",", "reasons").alias("reasons"))


def prune_plan(spark: SparkSession, d: str) -> DataFrame:
    prints = src.trades(spark, d)
    later = src.NOW_US + 20 * retention.DAY_US
    return retention.prune_plan(prints, tiers(spark, d), prints.where("count > 90"), later)


def raw_expiry(spark: SparkSession, d: str) -> DataFrame:
    left = retention.expire(src.trades(spark, d), tiers(spark, d), "ts_us", src.ORIGIN_US + 86_400_000_000)
    return left.groupBy("market_pk").agg(F.count("*").alias("rows_left"), F.sum("count").cast("double").alias("contracts_left"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    ev = src.read(spark, d, "events")
    severity = F.when(F.col("value") >= 40, "critical").when(F.col("value") >= 20, "high").when(F.col("value") >= 10, "medium").otherwise("low")
    return ev.select(
        F.col("user_id").alias("market_pk"), F.col("event_id").alias("alert_pk"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"), severity.alias("severity"), F.col("value").alias("score")
    )


def alert_rollup(spark: SparkSession, d: str) -> DataFrame:
    return retention.alert_rollup(alerts(spark, d))


def metrics_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the first half of the prints, with the second half folded in."""

    def counters(rows: DataFrame) -> DataFrame:
        return rows.groupBy("market_pk").agg(F.count("*").alias("trade_count"), F.max("ts_us").alias("last_us"), F.min("ts_us").alias("first_us"))

    prints = src.trades(spark, d)
    old, new = counters(prints.where("trade_pk % 2 = 0")), counters(prints.where("trade_pk % 2 = 1"))
    return merge.merge_upsert(old, new, ["market_pk"], {"trade_count": "add", "last_us": "greatest", "first_us": "least"})


def latest_merge(spark: SparkSession, d: str) -> DataFrame:
    """Market table whose quotes are replaced by the newest ones; a null last price keeps the old one."""
    target = src.markets(spark, d).select("market_pk", F.lit(0.5).alias("yes_bid"), F.lit(0.25).alias("last_price"))
    new = merge.newest(src.quotes(spark, d).select("market_pk", "ts_us", "quote_pk", "yes_bid", "last_price"), ["market_pk"], ["ts_us", "quote_pk"])
    return merge.merge_upsert(target, new, ["market_pk"], {"last_price": "coalesce_new_old"})


def article_keys(spark: SparkSession, d: str) -> DataFrame:
    return news.article_keys(src.articles(spark, d))


def article_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = news.article_tokens(src.articles(spark, d))
    return found.select("article_id", F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


def market_alerts(spark: SparkSession, d: str) -> DataFrame:
    book = stats.book_activity(src.book_events(spark, d), src.ORIGIN_US + 2_500_000_000, minutes=3)
    found = alerting.market_alerts(src.quotes(spark, d), book)
    return found.select("market_pk", "score", "severity", F.concat_ws(",", "reasons").alias("reasons"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    return tape.score_prints(src.trades(spark, d)).where("score >= 0.3")


def best_flags(spark: SparkSession, d: str) -> DataFrame:
    return alerting.best_flags(flags(spark, d), 5).select("market_pk", "trade_pk", "score", "rank", alerting.flag_severity(F.col("score")).alias("severity"))


def reason_codes(spark: SparkSession, d: str) -> DataFrame:
    found = alerting.reason_codes(flags(spark, d))
    return found.select("market_pk", F.concat_ws(",", "codes").alias("codes"))


def diversified_flags(spark: SparkSession, d: str) -> DataFrame:
    named = flags(spark, d).join(src.markets(spark, d).select("market_pk", "category", "event_id"), "market_pk", "left")
    named = named.select("market_pk", "trade_pk", "ts_us", "score", "category", "event_id")
    return alerting.diversified(named, 25, sports=("machinery", "building"))


def system_counters(spark: SparkSession, d: str) -> DataFrame:
    return alerting.system_counters(src.markets(spark, d), src.trades(spark, d), flags(spark, d))


def baseline_lookup(spark: SparkSession, d: str) -> DataFrame:
    markets = src.markets(spark, d).select("market_pk", "category", F.col("event_id").alias("subcategory"))
    found = alerting.baseline_of_market(markets, stats.peer_baselines(src.trades(spark, d).join(markets, "market_pk", "left")))
    return found.select("market_pk", "scope", "sample_size", F.round("count_p95", 6).alias("count_p95"), F.round("move_p95", 6).alias("move_p95"))


def quote_suppression(spark: SparkSession, d: str) -> DataFrame:
    coarse = src.quotes(spark, d).withColumns({"yes_bid": F.round("yes_bid", 1), "volume": F.round(F.col("volume").cast("double"), -2)})
    return folds.suppress_unchanged(coarse.select("market_pk", "quote_pk", "ts_us", "yes_bid", "volume"), ["yes_bid"], ["volume"], 120_000_000)


def quote_throttle(spark: SparkSession, d: str) -> DataFrame:
    rows = src.quotes(spark, d).select("market_pk", "quote_pk", "ts_us", F.col("last_price").isNotNull().alias("priced"))
    return folds.throttle(rows, ["market_pk"], ["ts_us", "quote_pk"], 60_000_000, bypass="priced")


def alert_episodes(spark: SparkSession, d: str) -> DataFrame:
    return folds.alert_episodes(alerts(spark, d), 3.0, 48 * 3_600_000_000)


def market_list(spark: SparkSession, d: str) -> DataFrame:
    counters = stats.trade_stats(src.trades(spark, d)).select("market_pk", "trade_count", "last_us")
    rank = scores.prior_rank(F.col("prior"))
    named = src.markets(spark, d).join(counters, "market_pk", "left").withColumn("urgency", scores.urgency_score(rank, F.coalesce("trade_count", F.lit(0))))
    found = listings.market_list(named.drop("trade_count", "last_us"), counters, flags(spark, d), "urgency", 100)
    return found.select("market_pk", "market_id", "trade_count", "last_us", "urgency", "top_flag", "flags")


def event_groups(spark: SparkSession, d: str) -> DataFrame:
    return listings.event_groups(src.markets(spark, d))


def link_prints(spark: SparkSession, d: str) -> DataFrame:
    links = news_links(spark, d).where("relevance >= 0.45")
    found = listings.link_prints(links, src.trades(spark, d), 24 * 3_600_000_000, 1000)
    return found.select("news_id", "market_pk", "trade_pk", "place")


def known_prices(spark: SparkSession, d: str) -> DataFrame:
    prints = src.trades(spark, d)
    price = scores.display_price(F.col("last_price"), F.col("yes_bid"), F.col("yes_ask"))
    quoted = stats.latest_per_market(src.quotes(spark, d)).select("market_pk", price.alias("price"))
    barred = bars.price_bars(prints, src.quotes(spark, d), 300).groupBy("market_pk").agg(F.max_by("close_price", "bucket").alias("price"))
    traded = prints.groupBy("market_pk").agg(F.max_by("yes_price", F.struct("ts_us", "trade_pk")).alias("price"))
    keys = src.markets(spark, d).select("market_pk")
    return listings.first_known(keys, [("quote", quoted), ("bar", barred), ("trade", traded)], "market_pk", "price")


def series_merge(spark: SparkSession, d: str) -> DataFrame:
    fine = bars.price_bars(src.trades(spark, d), src.quotes(spark, d), 300)
    coarse = bars.merge_bars(fine, 900)
    return listings.merge_series([(0, fine), (1, coarse)], ["market_pk", "bucket"], "close_price")


def quote_prune(spark: SparkSession, d: str) -> DataFrame:
    quotes = src.quotes(spark, d)
    five = bars.price_bars(src.trades(spark, d), quotes, 300).where("trade_count > 2")
    return listings.covered_quotes(quotes, five, 300, quotes.where("volume > 90"), F.lit(src.ORIGIN_US + 1_800_000_000))


def market_changes(spark: SparkSession, d: str) -> DataFrame:
    old = src.markets(spark, d).select("market_pk", "status", "prior")
    new = old.where("market_pk % 7 > 0").withColumn("status", F.when(F.col("market_pk") % 5 == 0, "settled").otherwise(F.col("status")))
    more = old.where("market_pk % 7 = 0").withColumn("market_pk", F.col("market_pk") + 10_000_000)
    return merge.row_changes(old, new.unionByName(more), ["market_pk"])


def sampled_prints(spark: SparkSession, d: str) -> DataFrame:
    prints = src.trades(spark, d).join(tiers(spark, d).select("market_pk", "tier", "sample_rate"), "market_pk", "left")
    kept = prints.where(scores.keyed_sample(F.col("trade_pk").cast("string"), F.coalesce("sample_rate", F.lit(0.1))))
    return kept.groupBy("tier").agg(F.count("*").alias("prints"), F.sum("count").cast("double").alias("contracts"))


def first_articles(spark: SparkSession, d: str) -> DataFrame:
    shared = src.articles(spark, d).withColumn("url", F.concat(F.lit("http://x/"), (F.col("article_id") % 50).cast("string")))
    return news.first_per_url(shared).select("article_id", "url", "first_seen_us")


def raw_markets(spark: SparkSession, d: str) -> DataFrame:
    """Market metadata whose tags and exchange category follow from the market's key."""
    texts = F.array(*[F.lit(r[0].title()) for r in classify.TAG_RULES], F.lit("Misc"), F.lit("Other"), F.lit("Local"))
    names = F.array(*[F.lit(c) for c in classify.CATEGORIES], F.lit("Unheard of"))
    key = F.col("market_pk")
    tag = F.get(texts, (key % 36).cast("int"))
    return src.markets(spark, d).select(
        "market_pk", F.when(key % 4 > 0, F.array(F.lit("Daily"), tag)).alias("tag_list"), F.get(names, (key % 14).cast("int")).alias("exchange_category")
    )


def market_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_markets(spark, d)
    found = classify.classify(raw, [classify.taxonomy_label(F.col("tag_list"), F.col("exchange_category"))])
    return found.select("market_pk", "category", "subcategory", "rule", "confidence", "tags", "prior")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tape_scores, price_bars, hourly_bars, side_volume, minute_features, tape_bursts, burst_summary, quote_asof, follow_through, news_after, news_before,
        peer_baselines, trade_stats, latest_quotes, book_activity, market_breakdowns, top_markets, market_lifecycle, market_scores, retention_tiers,
        prune_plan, raw_expiry, alert_rollup, metrics_merge, latest_merge, article_keys, article_tokens, market_alerts,
        best_flags, reason_codes, diversified_flags, system_counters, baseline_lookup, quote_suppression, quote_throttle,
        alert_episodes, market_list, event_groups, link_prints, known_prices, series_merge, quote_prune, market_changes, sampled_prints, first_articles,
        market_labels,
    )
}
