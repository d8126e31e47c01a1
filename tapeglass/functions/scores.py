"""Score, label and key expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE_STATUSES = ("active", "open")
# Priors from weakest to strongest.
PRIORS = ("very_low", "low", "medium", "medium_high", "high")
# Retention signals as (name, points).
SIGNALS = {
    "high_prior": 30,
    "medium_prior": 10,
    "closing_soon": 20,
    "volume_24h_floor": 15,
    "open_interest_floor": 10,
    "materialized_anomaly": 35,
    "severe_anomaly": 40,
    "price_zscore": 25,
    "trade_burst": 25,
    "news_match": 30,
    "pre_news_directional_move": 40,
    "l2_pull": 20,
}
# Storage tiers as (least score, name, raw hours to live, share sampled).
TIERS = ((110, "case", None, 1.0), (80, "triggered", 720, 1.0), (50, "hot", 168, 1.0), (20, "sampled", 24, 0.1), (0, "observe_only", 1, 0.0))


def prior_rank(prior: Column) -> Column:
    """Place of the prior from 0 (weakest); -1 for any other value or null."""
    return reduce(lambda c, x: c.when(prior == x[1], x[0]), enumerate(PRIORS), F.when(F.lit(False), -1)).otherwise(-1)


def evidence_score(count: Column) -> Column:
    """0 to 100, saturating with the number of stored alerts."""
    n = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))
    return F.least(F.lit(100), F.bround(100 * F.log1p(F.least(n, F.lit(10_000))) / F.log1p(F.lit(50.0)))).cast("int")


def urgency_value(rank: Column, count: Column) -> Column:
    return F.when(count > 0, (8.0 + 0.4 * (F.greatest(rank, F.lit(0)) + 1.0)) * F.log(1.0 + count)).otherwise(0.0)


def urgency_score(rank: Column, count: Column) -> Column:
    return F.least(F.lit(100), F.bround(100 * (1 - F.exp(-urgency_value(rank, count) / 24.0)))).cast("int")


def reason_code(reason: Column) -> Column:
    """Lower-case slug of at most 128 characters; "unknown" if nothing is left."""
    slug = F.regexp_replace(F.lower(F.trim(reason)), "[^a-z0-9]+", "_")
    short = F.substring(F.regexp_replace(slug, "^_+|_+$", ""), 1, 128)
    return F.when(short == "", "unknown").otherwise(short)


def bucket_start(ts_us: Column, interval_sec: int) -> Column:
    """Start of the bucket in epoch seconds."""
    width = max(1, interval_sec)
    return (F.floor(ts_us / F.lit(1_000_000 * width)) * width).cast("long")


def lifecycle(status: Column, close_us: Column, stale: Column, now_us: int) -> Column:
    """active / historical / unknown / out_of_scope / other, the first rule that holds."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(stale, "historical")
        .when(s.isin(*ACTIVE_STATUSES) & (close_us.isNull() | (close_us > now_us)), "active")
        .when(s.isin("unknown", "out_of_scope"), s)
        .when(close_us <= now_us, "historical")
        .when((s != "") & ~s.isin(*ACTIVE_STATUSES), "historical")
        .otherwise("other")
    )


def event_date(market_id: Column) -> Column:
    """Date of a YYMONDD token of the id, null where there is none or it is no date."""
    months = "(?:JAN|MAR|MAY|JUL|AUG|OCT|DEC)(?:0[1-9]|[12][0-9]|3[01])|(?:APR|JUN|SEP|NOV)(?:0[1-9]|[12][0-9]|30)|FEB(?:0[1-9]|1[0-9]|2[0-9])"
    token = F.regexp_extract(F.upper(market_id), f"[0-9]{{2}}(?:{months})", 0)
    return F.try_to_timestamp(F.when(token != "", token), F.lit("yyMMMdd"))


def stale_event(market_id: Column, now_us: int, hours: int = 30) -> Column:
    """Whether the id's date lies ``hours`` or more before now; false without a date."""
    return F.coalesce(F.unix_micros(event_date(market_id)) + F.lit(hours * 3_600_000_000) <= now_us, F.lit(False))


def in_scope(category: Column, prior: Column) -> Column:
    """Nulls stay in scope."""
    dropped = category.isin("exotic_combo", "crypto_strike"), prior == "very_low"
    return ~F.coalesce(dropped[0], F.lit(False)) & ~F.coalesce(dropped[1], F.lit(False))


def retention_reasons(prior: Column, closing_soon: Column, volume_24h: Column, open_interest: Column, has_alert: Column, signal: dict[str, Column] | None = None) -> Column:
    """Names of the retention signals that hold, in their fixed order. ``signal``: severe (boolean),
    price_zscore, burst_score, news_score, pre_news_move (boolean), l2_pull_score, those that are known."""
    known = {k: F.lit(None) for k in ("severe", "price_zscore", "burst_score", "news_score", "pre_news_move", "l2_pull_score")} | (signal or {})
    tests = {
        "high_prior": prior.isin("high", "medium_high"),
        "medium_prior": prior == "medium",
        "closing_soon": closing_soon,
        "volume_24h_floor": volume_24h >= 250,
        "open_interest_floor": open_interest >= 200,
        "materialized_anomaly": has_alert,
        "severe_anomaly": known["severe"].cast("boolean"),
        "price_zscore": known["price_zscore"] >= 3,
        "trade_burst": known["burst_score"] >= 3,
        "news_match": known["news_score"] >= 0.75,
        "pre_news_directional_move": known["pre_news_move"].cast("boolean"),
        "l2_pull": known["l2_pull_score"] >= 3,
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def retention_score(reasons: Column) -> Column:
    points = F.create_map(*[x for k, v in SIGNALS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(reasons, F.lit(0), lambda total, r: total + F.coalesce(F.element_at(points, r), F.lit(0)))


def storage_tier(score: Column) -> Column:
    return reduce(lambda c, t: c.when(score >= t[0], t[1]), TIERS, F.when(F.lit(False), "")).otherwise("ignored")


def raw_ttl_hours(score: Column) -> Column:
    return reduce(lambda c, t: c.when(score >= t[0], F.lit(t[2]).cast("int")), TIERS, F.when(F.lit(False), 0)).otherwise(F.lit(None).cast("int"))


def sample_rate(score: Column) -> Column:
    return reduce(lambda c, t: c.when(score >= t[0], t[3]), TIERS, F.when(F.lit(False), 0.0)).otherwise(0.0)


def keyed_sample(key: Column, rate: Column) -> Column:
    """The same choice for the same key at every replay."""
    share = F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / float(16**13)
    return (rate >= 1) | ((rate > 0) & (share < rate))


def display_price(last: Column, bid: Column, ask: Column) -> Column:
    """Last price, else midpoint, else bid, else ask; within 0 and 1."""
    price = F.coalesce(last, (bid + ask) / 2, bid, ask)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), price))


def notional(side: Column, count: Column, yes_price: Column, no_price: Column) -> Column:
    """Dollars at risk: contracts times the taken side's price, with the other as fallback."""
    price = F.coalesce(F.when(F.lower(side) == "no", no_price).otherwise(yes_price), yes_price, no_price)
    return F.greatest(F.lit(0.0), count * price)


def canonical_url_hash(url: Column) -> Column:
    return F.sha2(F.lower(F.trim(url)), 256)
