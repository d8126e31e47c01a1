"""Category families of markets, and what a news search asks for a market."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPORTS = ("sports_outcome", "sports_derivative", "sports_prop")  # fixed values
# Starts of names of sports events, and words of sports titles.
SPORTS_STARTS = [
    "KXATP", "KXWTA", "KXITF", "KXMLB", "KXNBA", "KXNFL", "KXNHL", "KXNCAAF", "KXNCAAB", "KXMLS", "KXEPL", "KXSAUDIPLGAME", "KXEGYPLGAME", "KXCHAMPLGAME", "KXEUROPALGAME", "KXLALIGA",
    "KXSERIEA", "KXBUNDES", "KXUFC", "KXPGA", "KXDPWORLDTOUR", "KXF1RACE", "KXCRICKET", "KXNPB",
]
SPORTS_TITLE = (
    r"(?i)\b(vs\.?|winner\??|win the .*match|round of|qualification final|grand prix winner|open winner|tournament winner|fc\b|united\b|city\b|al[- ]|"
    r"nba|nfl|mlb|nhl|mls|ufc|f1|formula 1|tennis|golf|soccer|football|baseball|basketball|hockey)\b"
)
STOPWORDS = ["will", "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "and", "or", "be", "by", "is", "are", "was", "were", "this", "that", "above", "below", "than", "more", "less", "vs", "vs."]  # fixed values
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def lower(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def normal_category(category: Column, event_id: Column, market_id: Column, title: Column) -> Column:
    """The category that scores are read by: a sports one stays; by the name of the event (or market) or
    the words of the title it is sports_outcome; else the category, null without one."""
    kind = lower(category)
    symbol = F.upper(F.coalesce(F.nullif(F.trim(event_id), F.lit("")), F.trim(market_id), F.lit("")))
    by_name = F.exists(F.array(*[F.lit(s) for s in SPORTS_STARTS]), lambda s: F.startswith(symbol, s))
    by_title = F.regexp_like(F.trim(F.coalesce(title, F.lit(""))), F.lit(SPORTS_TITLE))
    return F.when(kind.isin(*SPORTS), kind).when(by_name | by_title, "sports_outcome").otherwise(F.nullif(kind, F.lit("")))


def category_family(normal: Column) -> Column:
    return F.when(normal.isin(*SPORTS), "sports").otherwise(F.coalesce(normal, F.lit("unclassified")))


def search_words(text: Column, most: int = 8) -> Column:
    """The first ``most`` words of two characters and more that are no stopwords, without punctuation
    but dots and hyphens; empty for null."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\?+\z", ""), r"(?U)[^\w\s.-]", " ")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*STOPWORDS))
    return F.array_join(F.slice(words, 1, most), " ")


def search_text(title: Column, subtitle: Column, market_id: Column) -> Column:
    """Title and subtitle as alternatives where both say something and differ, else the one that does,
    else the market's name."""
    t, s = search_words(title, 8), search_words(subtitle, 6)
    both = F.concat(F.lit("("), t, F.lit(") OR ("), s, F.lit(")"))
    return F.when((t != "") & (s != "") & (t != s), both).otherwise(F.coalesce(F.nullif(t, F.lit("")), F.nullif(s, F.lit("")), F.trim(F.coalesce(market_id, F.lit("")))))


def news_window(open_us: Column, close_us: Column, last_trade_us: Column, last_flag_us: Column, now_us: int) -> Column:
    """Struct (start_us, end_us, align): a week before to half a day after the last activity, within the
    market's life and now; thirty days before its close (or now) where there was no activity or
    nothing is left of that window."""
    focus = F.greatest(last_trade_us, last_flag_us)
    start = F.greatest(focus - 7 * DAY_US, open_us)
    end = F.least(focus + 12 * HOUR_US, F.lit(now_us), close_us)
    last = F.coalesce(close_us, F.lit(now_us))
    usual = F.struct((last - 30 * DAY_US).alias("start_us"), last.alias("end_us"), F.lit("default").alias("align"))
    active = F.struct(start.alias("start_us"), end.alias("end_us"), F.lit("activity").alias("align"))
    return F.when(focus.isNotNull() & (end > start), active).otherwise(usual)
