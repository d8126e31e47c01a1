"""Queries of message sources, news linking, labels and compaction over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeglass.operators import bars, classify, linking, listings, merge, news, stats, tape
from tapeglass.plans.queries import alerts, news_links
from tapeglass.plans.reading import ALERTS_SQL, LISTED_SQL, listed
from tapeglass.plans.sql import LINKS_SQL, SQL, bars_sql
from tapeglass.sources import adapters as src
from tapeglass.sources import messages, payloads
from tapeglass.streaming import jobs

FINAL_US = src.ORIGIN_US + 7 * 86_400_000_000


def text4(c: str):
    return F.col(c).cast("decimal(12,4)").cast("string")


def stored_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trade messages as JSON, read back, replayed once and stored if absent."""
    t = src.trades(spark, d)
    fields = F.struct(
        F.col("market_pk").cast("string").alias("market_ticker"), F.col("trade_pk").cast("string").alias("trade_id"), F.when(F.col("trade_pk") % 50 > 0, F.floor(F.col("ts_us") / 1000)).alias("ts_ms"),
        text4("yes_price").alias("yes_price_dollars"), text4("no_price").alias("no_price_dollars"), F.col("count").cast("string").alias("count_fp"), F.upper("taker_side").alias("taker_side"),
    )
    raw = t.select(F.to_json(F.struct(F.lit("trade").alias("type"), F.col("trade_pk").alias("seq"), fields.alias("msg"))).alias("value"))
    good, bad = messages.parse_trades(raw)
    kept = merge.insert_absent(good.where("cast(trade_id AS long) % 2 = 0"), good, ["trade_id"])
    sums = kept.groupBy("market_id").agg(F.count("*").alias("prints"), F.sum("count").cast("double").alias("contracts"), F.count_if(F.col("taker_side") == "yes").alias("yes_prints"))
    return sums.unionByName(bad.agg(F.lit("quarantine").alias("market_id"), F.count("*").alias("prints"), F.lit(0.0).alias("contracts"), F.lit(0).cast("long").alias("yes_prints")))


def latest_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Ticker messages as JSON, read back; the last one of each market."""
    q = src.quotes(spark, d)
    fields = F.struct(F.col("market_pk").cast("string").alias("market_ticker"), F.floor(F.col("ts_us") / 1000).alias("ts_ms"), text4("last_price").alias("price_dollars"), text4("yes_bid").alias("yes_bid_dollars"), F.col("volume").cast("string").alias("volume"))
    raw = q.select(F.to_json(F.struct(F.lit("ticker").alias("type"), F.col("quote_pk").alias("seq"), fields.alias("msg"))).alias("value"))
    found = jobs.latest_in_batch(messages.parse_tickers(raw))
    return found.select("market_id", "seq", F.col("yes_bid").cast("double").alias("yes_bid"), F.col("last_price").cast("double").alias("last_price"), F.col("volume").cast("double").alias("volume"))


def book_levels(spark: SparkSession, d: str) -> DataFrame:
    """Book messages as JSON, snapshots with two levels and deltas, read back."""
    b = src.book_events(spark, d)
    size = F.abs("delta").cast("string")
    level = F.array(F.array(F.lit("0.4000"), size), F.array(F.lit("0.3000")), F.array(F.lit("0.2000"), size))
    fields = F.struct(
        F.col("market_pk").cast("string").alias("market_ticker"), F.floor(F.col("received_us") / 1000).alias("ts_ms"), F.when(F.col("is_snapshot"), level).alias("yes_dollars_fp"),
        F.when(F.col("seq") % 7 > 0, F.lit("no")).otherwise("maybe").alias("side"), F.lit("0.5500").alias("price_dollars"), F.col("delta").cast("string").alias("delta_fp"),
    )
    kind = F.when(F.col("is_snapshot"), "orderbook_snapshot").otherwise("orderbook_delta")
    raw = b.select(F.to_json(F.struct(kind.alias("type"), "seq", fields.alias("msg"))).alias("value"))
    rows = messages.parse_book(raw)
    return rows.groupBy("market_id", "side", "is_snapshot").agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("sizes"), F.coalesce(F.sum("delta"), F.lit(0)).cast("double").alias("deltas"))


def loaded_markets(spark: SparkSession, d: str) -> DataFrame:
    m = src.markets(spark, d)
    fields = F.struct(
        F.col("market_id").alias("ticker"), F.col("event_id").alias("event_ticker"), F.when(F.col("market_pk") % 5 > 0, F.concat(F.lit("Title "), F.col("market_pk").cast("string"))).otherwise(" ").alias("title"),
        F.when(F.col("market_pk") % 3 > 0, "").otherwise("Yes side").alias("yes_sub_title"), F.lit("No side").alias("no_sub_title"), F.when(F.col("market_pk") % 4 > 0, F.col("status")).alias("status"), F.col("category"),
    )
    found = payloads.parse_markets(m.select(F.to_json(fields).alias("value")))
    return found.select("market_id", "event_id", "title", "subtitle", "status", "category")


def search_articles(spark: SparkSession, d: str) -> DataFrame:
    a = src.articles(spark, d)
    seen = F.when(F.col("article_id") % 2 == 0, F.date_format(F.timestamp_micros("first_seen_us"), "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.date_format(F.timestamp_micros("first_seen_us"), "yyyy-MM-dd HH:mm:ss"))
    one = F.struct(F.when(F.col("article_id") % 10 > 0, F.col("url")).alias("url"), F.col("title"), seen.alias("seendate"))
    found = payloads.parse_search(a.select(F.to_json(F.struct(F.array(one).alias("articles"))).alias("value")))
    return found.select("url", F.length("title").alias("title_chars"), "domain", F.unix_micros("seen_at").alias("seen_us"))


def register_articles(spark: SparkSession, d: str) -> DataFrame:
    """Register entries whose agencies are words of the text, and bills beside them."""
    docs = src.read(spark, d, "documents")
    agency = F.transform(F.slice(F.split("source", "[^a-z]+"), 1, 9), lambda w: F.struct(F.concat(F.lit("Office "), w).alias("name")))
    one = F.struct(F.concat(F.lit("http://r/"), F.col("doc_id").cast("string")).alias("html_url"), F.lit("t").alias("title"), agency.alias("agencies"), F.lit("2024-01-02").alias("publication_date"))
    entries = payloads.parse_register(docs.select(F.to_json(F.struct(F.array(one).alias("results"))).alias("value")))
    bill = F.struct(F.concat(F.lit("http://b/"), F.col("doc_id").cast("string")).alias("url"), F.lit("HR").alias("type"), F.col("doc_id").cast("string").alias("number"), F.lit("2024-01-03").alias("introducedDate"))
    bills = payloads.parse_bills(docs.select(F.to_json(F.struct(F.array(bill).alias("bills"))).alias("value")))
    both = entries.select("url", "title", F.array_join("keywords", " ").alias("keywords"), "published_at").unionByName(bills.select("url", "title", F.lit("").alias("keywords"), "published_at"))
    return both.select("url", "title", "keywords", F.unix_micros("published_at").alias("published_us"))


def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    """RSS payloads read back: the 20 newest items of each feed since a day."""
    a = src.articles(spark, d)
    day = F.date_format(F.timestamp_micros("first_seen_us"), "d MMM yyyy HH:mm:ss +0000")
    xml = F.concat(
        F.lit("<rss><channel><item><title> Item "), F.col("article_id").cast("string"), F.lit(" & more</title><link>"), F.col("url"), F.lit("</link><description>&lt;b&gt;bold&lt;/b&gt; text</description><pubDate>Mon, "), day,
        F.lit("</pubDate></item><item><title>second</title><link>x</link></item></channel></rss>"),
    )
    items = news.feed_items(a.select(F.col("domain").alias("feed_url"), F.lit("rss").alias("source_tier"), xml.alias("xml_text")))
    recent = items.where(F.col("published").isNotNull() & (F.unix_micros("published") >= src.ORIGIN_US - 43_200_000_000))
    place = F.row_number().over(Window.partitionBy("feed_url").orderBy(F.desc("published"), "link"))
    return recent.withColumn("place", place).where("place <= 20").select("feed_url", "title", "link", "summary", F.unix_micros("published").alias("published_us"))


def profile_markets(spark: SparkSession, d: str) -> DataFrame:
    """Markets whose title is the first line of the article of the same number."""
    lines = src.articles(spark, d).select(F.col("article_id").alias("market_pk"), "title")
    return src.markets(spark, d).select("market_pk", "category", "market_id", "event_id").join(lines, "market_pk")


def market_profiles(spark: SparkSession, d: str) -> DataFrame:
    found = linking.market_profiles(profile_markets(spark, d))
    return found.select("market_pk", "category", F.array_join("keywords", " ").alias("keywords"), F.array_join("aliases", " ").alias("aliases"))


def refreshed_profiles(spark: SparkSession, d: str) -> DataFrame:
    made = src.markets(spark, d).where("market_pk % 3 > 0").select("market_pk", (F.col("close_us") - F.col("market_pk")).alias("made_us"))
    return linking.stale_profiles(made, src.markets(spark, d), 60)


def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    texts = src.articles(spark, d).select("article_id", "domain", F.col("title").alias("text"))
    found = linking.news_candidates(texts, linking.market_profiles(profile_markets(spark, d)), 8)
    markets = src.markets(spark, d).select("market_pk", "category")
    return found.join(texts.select("article_id", "domain"), "article_id").join(markets, "market_pk")


def news_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidate_rows(spark, d).select("article_id", "market_pk", "score", "hits", "named")


def gated_links(spark: SparkSession, d: str) -> DataFrame:
    """Candidates after source quality and the category gate; few shared terms count as a factor only."""
    tier = F.when(F.length("domain") % 3 == 0, "official").when(F.length("domain") % 3 == 1, "specialist").otherwise("broad")
    kind = F.when(F.col("category") == "machinery", "weather").when(F.col("category") == "building", "politics").when(F.col("category") == "furniture", "macro").otherwise(F.col("category"))
    rows = candidate_rows(spark, d).withColumns({"tier": tier, "kind": kind, "direct": F.col("hits") >= 2, "factor": F.lit(True)})
    return rows.select(
        "article_id", "market_pk", F.round(linking.source_quality(F.col("score") / 5, F.col("tier")), 6).alias("relevance"),
        linking.category_gate(F.col("kind"), F.col("direct"), F.col("factor"), F.col("tier")).alias("gate"),
    )


def stored_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles upserted by the hash of their address; the first time of seeing stays."""
    rows = src.articles(spark, d).select(F.sha2(F.lower(F.trim("url")), 256).alias("url_hash"), F.length("title").alias("title_chars"), "first_seen_us", "article_id")
    old = rows.where("article_id % 3 = 0").withColumn("title_chars", F.lit(0))
    return merge.merge_upsert(old, rows.withColumn("first_seen_us", F.col("first_seen_us") + 1000), ["url_hash"], {"first_seen_us": "keep_old"})


def stored_links(spark: SparkSession, d: str) -> DataFrame:
    old = news_links(spark, d).where("relevance < 0.5").select("news_id", "market_pk", F.lit(0.1).alias("relevance"))
    return merge.merge_upsert(old, news_links(spark, d).where("relevance >= 0.3").select("news_id", "market_pk", "relevance"), ["news_id", "market_pk"], {})


def checked_labels(spark: SparkSession, d: str) -> DataFrame:
    m = src.markets(spark, d)
    names = F.struct(
        F.when(F.col("market_pk") % 4 == 0, "Nonsense").when(F.col("market_pk") % 4 == 1, "Macro").otherwise("weather").alias("category"),
        F.when(F.col("market_pk") % 3 == 0, "cpi").when(F.col("market_pk") % 3 == 1, "temperature").otherwise("what").alias("subcategory"),
        F.when(F.col("market_pk") % 5 == 0, "sure").otherwise("HIGH").alias("confidence"),
    )
    allowed = spark.createDataFrame(sorted({(r[1], r[2]) for r in classify.TAG_RULES}), "category string, subcategory string")
    return linking.checked_labels(m.select("market_pk", F.to_json(names).alias("value")), allowed)


def label_targets(spark: SparkSession, d: str) -> DataFrame:
    versions = src.markets(spark, d).select("market_pk", F.when(F.col("market_pk") % 3 > 0, F.col("market_pk") % 4).alias("version"))
    counts = src.trades(spark, d).groupBy("market_pk").agg(F.count("*").alias("prints"))
    return linking.label_targets(versions, counts, 3, 80)


def sorted_markets(spark: SparkSession, d: str, sort: str) -> DataFrame:
    counters = stats.trade_stats(src.trades(spark, d)).select("market_pk", "trade_count", "last_us")
    linked = news_links(spark, d).where("relevance >= 0.45").groupBy("market_pk").agg(F.max("relevance").alias("top_news"))
    high = alerts(spark, d).groupBy("market_pk").agg(F.count_if(F.col("severity").isin("high", "critical")).alias("high_alerts"), F.count("*").alias("alerts"))
    rank = F.when(F.col("prior") == "high", 4).when(F.col("prior") == "medium_high", 3).when(F.col("prior") == "medium", 2).when(F.col("prior") == "low", 1).otherwise(0)
    named = src.markets(spark, d).join(linked, "market_pk", "left").join(high, "market_pk", "left").fillna(0, ["alerts", "high_alerts"]).withColumn("priority", rank)
    flags = tape.score_prints(src.trades(spark, d)).where("score >= 0.3")
    found = listings.market_list(named, counters, flags, sort, 60)
    return found.select("market_pk", "priority", "trade_count", "top_flag", "top_news", "high_alerts")


def markets_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return sorted_markets(spark, d, "priority")


def markets_by_news(spark: SparkSession, d: str) -> DataFrame:
    return sorted_markets(spark, d, "news_flag")


def markets_by_alerts(spark: SparkSession, d: str) -> DataFrame:
    return sorted_markets(spark, d, "alerts")


def compacted_bars(spark: SparkSession, d: str) -> DataFrame:
    """Closed markets' 5-minute bars replaced by hourly ones, the others kept; counts by interval."""
    fine = bars.price_bars(src.trades(spark, d), src.quotes(spark, d), 300)
    closed = src.markets(spark, d).where(F.col("close_us") <= FINAL_US).select("market_pk")
    new, kept = bars.compact(fine, closed, 300, 3600)
    rows = kept.select("market_pk", "trade_count", "trade_volume", F.lit(300).alias("interval")).unionByName(new.select("market_pk", "trade_count", "trade_volume", F.lit(3600).alias("interval")))
    return rows.groupBy("interval").agg(F.count("*").alias("bars"), F.sum("trade_count").alias("prints"), F.sum("trade_volume").cast("double").alias("volume"))


def backfilled_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars made anew from the 40 newest prints and quotes of each market."""

    def newest(rows: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("market_pk").orderBy(F.desc("ts_us"), F.desc(key)))
        return rows.withColumn("place", place).where("place <= 40").drop("place")

    made = bars.price_bars(newest(src.trades(spark, d), "trade_pk"), newest(src.quotes(spark, d), "quote_pk"), 300)
    return made.select("market_pk", "bucket", "trade_count", "quote_count", "close_price")


QUERIES = {
    f.__name__: f
    for f in (
        stored_trades, latest_tickers, book_levels, loaded_markets, search_articles, register_articles, feed_articles, market_profiles, refreshed_profiles, news_candidates, gated_links,
        stored_articles, stored_links, checked_labels, label_targets, markets_by_priority, markets_by_news, markets_by_alerts, compacted_bars, backfilled_bars,
    )
}

TELLING = f"""[t FOR t IN list_distinct(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_.-]*')) IF NOT list_contains({linking.GENERIC!r}, t) AND NOT starts_with(t, 'kx')
    AND NOT regexp_matches(t, '^[0-9]+[.]?[0-9]*$') AND (length(t) > 2 OR list_contains({linking.SHORT!r}, t))]"""
FIRST_TERMS = f"list_sort(list_transform(list_distinct({TELLING}), lambda t: {{'at': list_position(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_.-]*'), t), 't': t}}))[1:24]"
PROFILE_SQL = f"""{src.ARTICLES_SQL}, {src.MARKETS_SQL},
pm AS (SELECT m.market_pk, m.category, m.market_id, m.event_id, title FROM markets m JOIN articles a ON a.article_id = m.market_pk),
prof AS (SELECT market_pk, category, [x.t FOR x IN {FIRST_TERMS}] AS keywords, list_distinct([lower(market_id), lower(event_id)]) AS aliases, lower(market_id) AS a1, lower(event_id) AS a2 FROM pm)"""
CANDIDATE_SQL = f"""{PROFILE_SQL},
w AS (SELECT article_id, domain, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_.-]*'))) AS term FROM articles),
k AS (SELECT market_pk, unnest(keywords) AS term, 0 AS alias FROM prof UNION ALL SELECT market_pk, unnest(aliases), 1 FROM prof),
h AS (SELECT article_id, domain, market_pk, count(*) FILTER (alias = 0) AS hits, max(alias) AS named FROM w JOIN k USING (term) GROUP BY ALL),
cand AS (SELECT *, CAST(least(3.0, 0.75 * hits) + 2.0 * named AS DOUBLE) AS score FROM h QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY least(3.0, 0.75 * hits) + 2.0 * named DESC, market_pk) <= 8)"""
SORTED_SQL = f"""WITH s AS ({SQL["tape_scores"]}), {src.TRADES_SQL}, {LINKS_SQL}, {src.MARKETS_SQL}, {ALERTS_SQL},
t AS (SELECT market_pk, count(*) AS trade_count FROM trades GROUP BY market_pk), f AS (SELECT market_pk, max(score) AS top_flag FROM s WHERE score >= 0.3 GROUP BY market_pk),
n AS (SELECT market_pk, max(relevance) AS top_news FROM links WHERE relevance >= 0.45 GROUP BY market_pk),
a AS (SELECT market_pk, count(*) FILTER (severity IN ('high', 'critical')) AS high_alerts, count(*) AS alerts FROM alerts GROUP BY market_pk),
j AS (SELECT m.market_pk, CASE prior WHEN 'high' THEN 4 WHEN 'medium_high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS priority, coalesce(trade_count, 0) AS trade_count, top_flag, top_news,
    coalesce(high_alerts, 0) AS high_alerts, coalesce(alerts, 0) AS alerts FROM markets m LEFT JOIN t USING (market_pk) LEFT JOIN f USING (market_pk) LEFT JOIN n USING (market_pk) LEFT JOIN a USING (market_pk))
SELECT market_pk, priority, trade_count, top_flag, top_news, high_alerts FROM j ORDER BY """
VOCABULARY = sorted({(r[1], r[2]) for r in classify.TAG_RULES})
PAIRS = ", ".join(f"('{c}', '{s}')" for c, s in VOCABULARY)

NEWSROOM_SQL: dict[str, str] = {
    "stored_trades": f"""WITH {src.TRADES_SQL}
SELECT CAST(market_pk AS VARCHAR) AS market_id, count(*) AS prints, CAST(sum(cnt) AS DOUBLE) AS contracts, count(*) FILTER (taker_side = 'yes') AS yes_prints FROM trades WHERE trade_pk % 50 > 0 GROUP BY market_pk
UNION ALL SELECT 'quarantine', count(*), 0.0, 0 FROM trades WHERE trade_pk % 50 = 0""",
    "latest_tickers": f"""WITH {src.QUOTES_SQL}
SELECT CAST(market_pk AS VARCHAR) AS market_id, quote_pk AS seq, yes_bid, last_price, CAST(volume AS DOUBLE) AS volume FROM quotes QUALIFY row_number() OVER (PARTITION BY market_pk ORDER BY quote_pk DESC) = 1""",
    "book_levels": f"""WITH {src.BOOK_SQL}
SELECT CAST(market_pk AS VARCHAR) AS market_id, 'no' AS side, false AS is_snapshot, count(*) AS rows, 0.0 AS sizes, CAST(sum(delta) AS DOUBLE) AS deltas FROM book WHERE NOT is_snapshot AND seq % 7 > 0 GROUP BY market_pk
UNION ALL SELECT CAST(market_pk AS VARCHAR), 'yes', true, 2 * count(*), CAST(2 * sum(abs(delta)) AS DOUBLE), 0.0 FROM book WHERE is_snapshot GROUP BY market_pk""",
    "loaded_markets": f"""WITH {src.MARKETS_SQL}
SELECT market_id, event_id, CASE WHEN market_pk % 5 > 0 THEN 'Title ' || CAST(market_pk AS VARCHAR) ELSE market_id END AS title, CASE WHEN market_pk % 3 > 0 THEN 'No side' ELSE 'Yes side' END AS subtitle,
  CASE WHEN market_pk % 4 > 0 THEN status ELSE 'unknown' END AS status, category FROM markets""",
    "search_articles": f"""WITH {src.ARTICLES_SQL}
SELECT url, CAST(nullif(length(trim(title)), 0) AS INT) AS title_chars, 'news.' || domain || '.example.com' AS domain, first_seen_us AS seen_us FROM articles WHERE article_id % 10 > 0""",
    "register_articles": """
SELECT 'http://r/' || CAST(doc_id AS VARCHAR) AS url, 't' AS title, array_to_string(list_concat(['regulation', 'office'], CASE WHEN regexp_replace(source, '[^a-z]+', '', 'g') = '' THEN [] ELSE [w FOR w IN regexp_split_to_array(source, '[^a-z]+') IF w <> ''] END), ' ') AS keywords,
  epoch_us(TIMESTAMP '2024-01-02') AS published_us FROM documents
UNION ALL SELECT 'http://b/' || CAST(doc_id AS VARCHAR), 'HR ' || CAST(doc_id AS VARCHAR), '', epoch_us(TIMESTAMP '2024-01-03') FROM documents""",
    "feed_articles": f"""WITH {src.ARTICLES_SQL}
SELECT domain AS feed_url, 'Item ' || CAST(article_id AS VARCHAR) || ' & more' AS title, url AS link, 'bold text' AS summary, first_seen_us AS published_us FROM articles WHERE first_seen_us >= {src.ORIGIN_US - 43_200_000_000}
QUALIFY row_number() OVER (PARTITION BY domain ORDER BY first_seen_us DESC, url) <= 20""",
    "market_profiles": f"WITH {PROFILE_SQL} SELECT market_pk, category, array_to_string(keywords, ' ') AS keywords, a1 || ' ' || a2 AS aliases FROM prof",
    "refreshed_profiles": f"""WITH {src.MARKETS_SQL}
SELECT market_pk, CASE WHEN market_pk % 3 > 0 THEN close_us - market_pk END AS made_us FROM markets ORDER BY made_us NULLS FIRST, market_pk LIMIT 60""",
    "news_candidates": f"WITH {CANDIDATE_SQL} SELECT article_id, market_pk, score, hits, named FROM cand",
    "gated_links": f"""WITH {CANDIDATE_SQL},
g AS (
  SELECT c.article_id, c.market_pk, least(1.0, score / 5) AS base, hits >= 2 AS direct, CASE length(c.domain) % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'specialist' ELSE 'broad' END AS tier,
    CASE m.category WHEN 'machinery' THEN 'weather' WHEN 'building' THEN 'politics' WHEN 'furniture' THEN 'macro' ELSE m.category END AS kind FROM cand c JOIN markets m ON m.market_pk = c.market_pk
)
SELECT article_id, market_pk, round(CASE WHEN tier = 'official' AND base >= 0.2 THEN least(1.0, base * 1.08 + 0.08) WHEN tier = 'specialist' AND base >= 0.3 THEN least(1.0, base * 1.03 + 0.03) ELSE base END, 6) AS relevance,
  CASE WHEN kind = 'politics' AND NOT direct THEN 'politics_requires_direct_market_anchor' WHEN kind NOT IN ('macro', 'weather') AND NOT direct THEN 'factor_only_not_allowed_for_category'
    WHEN kind = 'weather' AND NOT direct AND tier <> 'official' THEN 'weather_factor_requires_official_source_or_direct_anchor' ELSE 'accepted' END AS gate FROM g""",
    "stored_articles": f"""WITH {src.ARTICLES_SQL}
SELECT sha256(lower(trim(url))) AS url_hash, CAST(length(title) AS INT) AS title_chars, first_seen_us + CASE WHEN article_id % 3 = 0 THEN 0 ELSE 1000 END AS first_seen_us, article_id FROM articles""",
    "stored_links": f"WITH {LINKS_SQL} SELECT news_id, market_pk, CASE WHEN relevance >= 0.3 THEN relevance ELSE CAST(0.1 AS DOUBLE) END AS relevance FROM links",
    "checked_labels": f"""WITH {src.MARKETS_SQL}, v(c, s) AS (VALUES {PAIRS}),
r AS (SELECT market_pk, CASE market_pk % 4 WHEN 0 THEN 'nonsense' WHEN 1 THEN 'macro' ELSE 'weather' END AS c, CASE market_pk % 3 WHEN 0 THEN 'cpi' WHEN 1 THEN 'temperature' ELSE 'what' END AS s, market_pk % 5 > 0 AS sure FROM markets)
SELECT market_pk, CASE WHEN c IN (SELECT c FROM v) THEN c ELSE 'other' END AS category, CASE WHEN (c, s) IN (SELECT (c, s) FROM v) THEN s ELSE '*' END AS subcategory,
  CASE WHEN (c, s) IN (SELECT (c, s) FROM v) AND sure THEN 'high' ELSE 'low' END AS confidence FROM r""",
    "label_targets": f"""WITH {src.MARKETS_SQL}, v AS (SELECT market_pk, CASE WHEN market_pk % 3 > 0 THEN market_pk % 4 END AS version FROM markets), c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT market_pk, version, coalesce(n, 0) AS prints FROM v LEFT JOIN c ON user_id = market_pk WHERE version IS NULL OR version < 3 ORDER BY prints DESC, market_pk LIMIT 80""",
    "markets_by_priority": SORTED_SQL + "priority DESC, trade_count DESC, market_pk LIMIT 60",
    "markets_by_news": SORTED_SQL + "top_news DESC NULLS LAST, top_flag DESC NULLS LAST, market_pk LIMIT 60",
    "markets_by_alerts": SORTED_SQL + "high_alerts DESC, alerts DESC, market_pk LIMIT 60",
    "compacted_bars": f"""WITH f AS ({bars_sql(300)}), h AS ({bars_sql(3600)}), {src.MARKETS_SQL}, c AS (SELECT market_pk FROM markets WHERE close_us <= {FINAL_US}),
u AS (SELECT trade_count, trade_volume, 300 AS interval FROM f WHERE market_pk NOT IN (SELECT market_pk FROM c) UNION ALL SELECT trade_count, trade_volume, 3600 FROM h WHERE market_pk IN (SELECT market_pk FROM c))
SELECT interval, count(*) AS bars, CAST(sum(trade_count) AS BIGINT) AS prints, sum(trade_volume) AS volume FROM u GROUP BY interval""",
    "backfilled_bars": f"""WITH {src.TRADES_SQL}, {src.QUOTES_SQL},
t AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY market_pk ORDER BY ts_us DESC, trade_pk DESC) <= 40), q AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY market_pk ORDER BY ts_us DESC, quote_pk DESC) <= 40),
p AS (SELECT market_pk, ts_us, yes_price AS price, 3 AS rnk, false AS q FROM t UNION ALL SELECT market_pk, ts_us, coalesce(last_price, (yes_bid + yes_ask) / 2), CASE WHEN last_price IS NOT NULL THEN 2 ELSE 1 END, true FROM q)
SELECT market_pk, ts_us // 300000000 * 300 AS bucket, count(*) FILTER (NOT q) AS trade_count, count(*) FILTER (q) AS quote_count, arg_max(price, rnk * 10000000000000000 + ts_us) AS close_price FROM p GROUP BY ALL""",
}
