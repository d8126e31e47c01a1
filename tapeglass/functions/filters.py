"""Predicates and labels over market, quote, link and article columns. "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE = ("active", "open")  # fixed values
EXCLUDED_CATEGORIES = ("exotic_combo", "crypto_strike")  # fixed values
EXCLUDED_PRIORS = ("very_low",)  # fixed values
TERMINAL = ("closed", "settled", "finalized", "determined")  # fixed values


def yes(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def hydrated(status: Column, title: Column, market_id: Column) -> Column:
    """Metadata has been read: the status is known and in scope and the title is not the id."""
    return yes(~status.isin("unknown", "out_of_scope") & (title != market_id))


def news_linkable(status: Column, title: Column, market_id: Column, category: Column) -> Column:
    return yes((status != "unknown") & (title != market_id)) & (category.isNull() | (category != "exotic_combo"))


def profile_candidate(status: Column, title: Column, market_id: Column, category: Column) -> Column:
    """Worth a news profile; null status or category does not exclude."""
    named = (F.trim(title) != "") & (F.trim(title) != F.trim(F.coalesce(market_id, F.lit(""))))
    return yes(named) & ~yes(F.lower(status) == "unknown") & ~yes(F.lower(category) == "exotic_combo")


def active_scope(status: Column, close_us: Column, stale: Column, now_us: int) -> Column:
    """Trading now. A null status is historical, a null close time can be active."""
    return yes(status.isin(*ACTIVE)) & (close_us.isNull() | (close_us > now_us)) & ~yes(stale)


def historical_scope(status: Column, close_us: Column, stale: Column, now_us: int) -> Column:
    return status.isNull() | ~yes(status.isin(*ACTIVE)) | yes(close_us <= now_us) | yes(stale)


def out_of_scope(category: Column, prior: Column) -> Column:
    return yes(category.isin(*EXCLUDED_CATEGORIES)) | yes(prior.isin(*EXCLUDED_PRIORS))


def quote_gate(status: Column, category: Column, prior: Column) -> Column:
    """Markets whose quotes are worth keeping."""
    return yes(status.isin(*ACTIVE, "unknown")) & ~out_of_scope(category, prior)


def cents(dollars: Column) -> Column:
    """Whole cents, halves up."""
    return F.round(dollars.cast("decimal(18,6)") * 100, 0).cast("int")


def contracts(size: Column) -> Column:
    return F.round(size.cast("decimal(18,4)"), 0).cast("long")


def likely_resolved(last: Column, bid: Column, ask: Column, edge: int = 1) -> Column:
    """A quote in cents at the edge: displayed at or within ``edge`` of 0 or 100, or an empty book from edge to edge."""
    shown = F.coalesce(last.cast("double"), (bid + ask) / 2, bid.cast("double"), ask.cast("double"))
    return yes((shown <= edge) | (shown >= 100 - edge)) | yes((bid <= edge) & (ask >= 100 - edge))


def closed_long(status: Column, close_us: Column, updated_us: Column, stale: Column, now_us: int, grace_us: int) -> Column:
    """Closed for ``grace_us``: by close time, by a final status last updated so long ago, or by a dated ticker."""
    return yes(close_us <= now_us - grace_us) | yes(F.lower(status).isin(*TERMINAL) & (updated_us <= now_us - grace_us)) | yes(stale)


def weak_factor_link(label: Column, direct_score: Column, factor_score: Column, reasons: Column) -> Column:
    """Links that rest on a category factor alone and point nowhere."""
    alone = (F.size(reasons) == 1) & (F.get(reasons, F.lit(0)) == "category_factor")
    return yes((label == "ambiguous") & (F.coalesce(direct_score, F.lit(0.0)) <= 0) & (factor_score > 0) & alone)


def in_window(at_us: Column, since_us: int, until_us: int) -> Column:
    """Undated articles stay."""
    return at_us.isNull() | at_us.between(since_us, until_us)


def priority_label(prior: Column) -> Column:
    return F.when(F.coalesce(prior, F.lit("")) == "", "unclassified").otherwise(prior)


def freshness(latest_us: Column, count: Column, stale_us: int, now_us: int) -> Column:
    return F.when(yes(count <= 0) | latest_us.isNull(), "empty").when(now_us - latest_us > stale_us, "stale").otherwise("healthy")


def review_label(best_flag: Column, best_news: Column, alerts: Column, high_alerts: Column) -> Column:
    return (
        F.when((best_flag >= 8) & (best_news > 0), "strong_pre_news_review").when(best_flag >= 8, "strong_trade_review").when(best_news > 0, "pre_news_review")
        .when(high_alerts > 0, "quote_book_review").when((best_flag >= 5) | (alerts > 0), "weak_review").otherwise("quiet")
    )
