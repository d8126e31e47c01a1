"""Queries of filters, reports and maintenance over whole tables, and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.functions import filters, scores
from tapeglass.operators import merge, reads, stats, tape
from tapeglass.plans.queries import alerts, news_links, tiers
from tapeglass.plans.sql import LINKS_SQL, SQL, TIERS_SQL
from tapeglass.sources import adapters as src

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
NOW = src.NOW_US


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Markets with title, exchange status (some unknown or null) and time of update."""
    pk = F.col("market_pk")
    return src.markets(spark, d).select(
        "market_pk", "market_id", "event_id", "category", "prior", "close_us",
        F.when(pk % 5 == 0, F.col("market_id")).otherwise(F.concat(F.lit("Will "), F.initcap("event_id"), F.lit(" decide "), F.col("category"), F.lit("?"))).alias("title"),
        F.when(pk % 11 == 0, "unknown").when(pk % 13 == 0, None).otherwise(F.col("status")).alias("status"),
        (F.lit(src.ORIGIN_US) + pk % 96 * F.lit(HOUR_US)).alias("updated_us"),
    )


def market_filters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    stale = (c("market_pk") % 17 == 0).alias("stale")
    return listed(spark, d).select(
        "market_pk",
        filters.hydrated(c("status"), c("title"), c("market_id")).alias("hydrated"),
        filters.news_linkable(c("status"), c("title"), c("market_id"), c("category")).alias("news_linkable"),
        filters.profile_candidate(c("status"), c("title"), c("market_id"), c("category")).alias("profile_candidate"),
        filters.active_scope(c("status"), c("close_us"), stale, NOW).alias("active"),
        filters.historical_scope(c("status"), c("close_us"), stale, NOW).alias("historical"),
        filters.out_of_scope(c("category"), c("prior")).alias("out_of_scope"),
        filters.quote_gate(c("status"), c("category"), c("prior")).alias("quoted"),
        ((c("status") == "unknown") & (c("title") == c("market_id"))).alias("stale_stub"),
        filters.closed_long(c("status"), c("close_us"), c("updated_us"), F.lit(False), NOW, DAY_US).alias("closed_long"),
        filters.priority_label(c("prior")).alias("priority"),
    )


def market_search(spark: SparkSession, d: str) -> DataFrame:
    """Traded markets with the text in title, id or event."""
    found = listed(spark, d).where(F.ilike("title", F.lit("%ma%")) | F.ilike("market_id", F.lit("%ma%")) | F.ilike("event_id", F.lit("%ma%")))
    return found.join(src.trades(spark, d).select("market_pk"), "market_pk", "left_semi").select("market_pk", "title")


def cent_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = stats.latest_per_market(src.quotes(spark, d))
    return q.select("market_pk", "ts_us", *[filters.cents(F.col(c)).alias(f"{c}_cents") for c in ("yes_bid", "yes_ask", "last_price")])


def resolved_quotes(spark: SparkSession, d: str) -> DataFrame:
    found = cent_quotes(spark, d)
    return found.select("*", filters.likely_resolved(F.col("last_price_cents"), F.col("yes_bid_cents"), F.col("yes_ask_cents"), 5).alias("resolved"))


def link_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("news_id")
    label = F.when(k % 3 == 0, "supports_yes").when(k % 3 == 1, "supports_no").otherwise("ambiguous")
    reasons = F.when(k % 4 == 0, F.array(F.lit("category_factor"))).otherwise(F.array(F.lit("keyword_overlap"), F.lit("category_factor")))
    events = src.markets(spark, d).select("market_pk", "event_id")
    links = news_links(spark, d).withColumns({"label": label, "direct": (k % 2).cast("double"), "factor": F.lit(0.5), "link_reasons": reasons, "score": F.round(F.col("relevance") * 10, 6)})
    weak = filters.weak_factor_link(F.col("label"), F.col("direct"), F.col("factor"), F.col("link_reasons"))
    return links.join(events, "market_pk", "left").withColumn("weak", weak)


def news_signals(spark: SparkSession, d: str) -> DataFrame:
    return reads.signals(link_rows(spark, d), 50, 4.0, 5000).select("news_id", "market_pk", "event_id", "score", "label")


def weak_links(spark: SparkSession, d: str) -> DataFrame:
    return link_rows(spark, d).groupBy("label", "weak").agg(F.count("*").alias("links"))


def recent_articles(spark: SparkSession, d: str) -> DataFrame:
    dated = src.articles(spark, d).withColumn("first_seen_us", F.when(F.col("article_id") % 9 > 0, F.col("first_seen_us")))
    return dated.where(filters.in_window(F.col("first_seen_us"), src.ORIGIN_US, src.ORIGIN_US + DAY_US)).select("article_id", "first_seen_us")


def baseline_run(spark: SparkSession, d: str) -> DataFrame:
    """Baselines of the 5,000 oldest prints of the last half hour, replacing those stored before."""
    markets = src.markets(spark, d).select("market_pk", "category", F.col("event_id").alias("subcategory"))
    recent = src.trades(spark, d).where(F.col("ts_us") >= src.ORIGIN_US + 800_000_000).orderBy("ts_us", "trade_pk").limit(5000)
    keys = ["category", "subcategory"]
    made = stats.peer_baselines(recent.join(markets, "market_pk", "left")).select(*keys, "sample_size", F.round("count_p95", 6).alias("count_p95"), F.lit(2).alias("version"))
    stored = markets.select("category", F.lit("*").alias("subcategory"), F.lit(0).cast("long").alias("sample_size"), F.lit(0.0).alias("count_p95"), F.lit(1).alias("version")).distinct()
    return merge.merge_upsert(stored, made, keys, {})


def alert_stats(spark: SparkSession, d: str) -> DataFrame:
    return reads.alert_stats(alerts(spark, d))


def alert_counters(spark: SparkSession, d: str) -> DataFrame:
    """Stored alert counters with the newer half of the alerts folded in."""
    rows = alerts(spark, d)
    old, new = (reads.alert_stats(rows.where(F.col("alert_pk") % 2 == k)) for k in (0, 1))
    return merge.merge_upsert(old, new, ["market_pk"], {"alerts": "add", "high_alerts": "add", "last_alert_us": "greatest"})


def market_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All counters and scores of every market made anew."""
    prints = stats.trade_stats(src.trades(spark, d)).select("market_pk", "trade_count", F.col("last_us").alias("last_trade_us"), "contracts")
    rows = src.markets(spark, d).select("market_pk", "prior").join(cent_quotes(spark, d).withColumnRenamed("ts_us", "quote_us"), "market_pk", "left")
    rows = rows.join(prints, "market_pk", "left").join(alert_stats(spark, d), "market_pk", "left").fillna(0, ["trade_count", "contracts", "alerts", "high_alerts"])
    rank = scores.prior_rank(F.col("prior"))
    return rows.select(*[c for c in rows.columns if c != "prior"], scores.evidence_score(F.col("alerts")).alias("evidence"), scores.urgency_score(rank, F.col("alerts")).alias("urgency"))


def signal_history(spark: SparkSession, d: str) -> DataFrame:
    closed = src.markets(spark, d).where(F.col("close_us") <= NOW).select("market_pk", "close_us")
    flags = tape.score_prints(src.trades(spark, d)).where("score >= 0.3").select("market_pk", "trade_pk", "ts_us", "score")
    news = link_rows(spark, d).where("label <> 'ambiguous'").select("market_pk", "news_id", "score")
    return reads.signal_history(closed, flags, news, alerts(spark, d)).drop("close_us")


def retention_counts(spark: SparkSession, d: str) -> DataFrame:
    """Prints and contracts per tier that are past the tier's days, and markets of the tier."""
    from tapeglass.operators import retention

    prints = src.trades(spark, d)
    plan = retention.prune_plan(prints, tiers(spark, d), prints.where("count > 90"), NOW + 20 * DAY_US)
    counts = plan.groupBy("tier").agg(F.count("*").alias("prints"), F.count_if("pruned").alias("prunable"))
    return tiers(spark, d).groupBy("tier").agg(F.count("*").alias("markets"), F.max("ttl_hours").alias("ttl_hours")).join(counts, "tier", "left").fillna(0, ["prints", "prunable"])


def victims(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d).where(filters.out_of_scope(F.col("category"), F.col("prior")) | filters.yes((F.col("status") == "unknown") & (F.col("title") == F.col("market_id"))))


def prune_summary(spark: SparkSession, d: str) -> DataFrame:
    """Markets that go by category and prior, and their prints that go with them."""
    gone = victims(spark, d).select("market_pk", "category", "prior")
    children = src.trades(spark, d).join(gone.select("market_pk"), "market_pk", "left_semi").groupBy("market_pk").agg(F.count("*").alias("n"))
    return gone.join(children, "market_pk", "left").groupBy("category", "prior").agg(F.count("*").alias("markets"), F.coalesce(F.sum("n"), F.lit(0)).alias("prints"))


def cascaded_prints(spark: SparkSession, d: str) -> DataFrame:
    left = src.trades(spark, d).join(victims(spark, d).select("market_pk"), "market_pk", "left_anti")
    return left.groupBy("market_pk").agg(F.count("*").alias("prints"))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    value, at = F.col("value"), F.unix_micros(F.col("ts").cast("timestamp"))
    status = F.when(value > 80, "error").when(value > 20, "success").otherwise("running")
    return src.read(spark, d, "events").select(
        F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string")).alias("key"), status.alias("status"), at.alias("at_us"), F.col("event_id").alias("run"),
        F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).alias("count"), (status == "success").alias("success"), F.when(value > 80, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"),
    )


def job_states(spark: SparkSession, d: str) -> DataFrame:
    return reads.job_states(run_log(spark, d), 6 * HOUR_US, src.ORIGIN_US + 30 * DAY_US)


def pipeline_summary(spark: SparkSession, d: str) -> DataFrame:
    return reads.pipeline_summary(job_states(spark, d))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """Articles per source with its tier in the registry and the markets linked to them."""
    known = src.articles(spark, d).select("domain").distinct().withColumn("tier", F.when(F.length("domain") % 2 == 0, "official").otherwise("broad"))
    per = news_links(spark, d).where("relevance >= 0.45").groupBy(F.col("news_id").alias("article_id")).agg(F.count_distinct("market_pk").alias("linked"))
    rows = src.articles(spark, d).join(per, "article_id", "left")
    sums = rows.groupBy("domain").agg(F.count("*").alias("articles"), F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"), F.max("first_seen_us").alias("latest_us"))
    return sums.join(known, "domain", "left")


def display_series(spark: SparkSession, d: str) -> DataFrame:
    prints = src.trades(spark, d).select("market_pk", F.floor(F.col("ts_us") / 1_000_000).alias("unix"), F.col("yes_price").alias("value"), F.lit(3).alias("rank"))
    quoted = src.quotes(spark, d).select("market_pk", F.floor(F.col("ts_us") / 1_000_000).alias("unix"), F.coalesce("last_price", (F.col("yes_bid") + F.col("yes_ask")) / 2).alias("value"), F.lit(2).alias("rank"))
    return reads.uniform_series(prints.unionByName(quoted)).select("market_pk", "at", F.round("value", 6).alias("value"))


def trade_highlights(spark: SparkSession, d: str) -> DataFrame:
    return reads.trade_highlights(src.trades(spark, d))


def event_news(spark: SparkSession, d: str) -> DataFrame:
    """The 25 newest links of each market that are relevant enough, with the article's source."""
    from pyspark.sql import Window

    links = news_links(spark, d).where("relevance >= 0.45")
    joined = links.join(src.articles(spark, d).select(F.col("article_id").alias("news_id"), "domain"), "news_id").join(src.markets(spark, d).select("market_pk", "category"), "market_pk")
    place = F.row_number().over(Window.partitionBy("market_pk").orderBy(F.desc("news_us"), F.desc("news_id")))
    return joined.withColumn("place", place).where("place <= 25").select("market_pk", "news_id", "domain", "category", "place")


def status_audit(spark: SparkSession, d: str) -> DataFrame:
    local = listed(spark, d).select("market_pk", "status")
    theirs = src.markets(spark, d).where("market_pk % 10 > 0").select("market_pk", F.when(F.col("market_pk") % 8 == 0, "settled").otherwise(F.col("status")).alias("status"))
    return reads.status_audit(local, theirs)


def recent_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest alerts of active markets."""
    named = alerts(spark, d).join(src.markets(spark, d).where("status = 'active'").select("market_pk", "category"), "market_pk")
    return named.orderBy(F.desc("created_us"), "alert_pk").limit(50).select("alert_pk", "market_pk", "severity", "category")


def filled_alerts(spark: SparkSession, d: str) -> DataFrame:
    """40 alerts: the newest critical ones, filled up with high ones."""
    rows = alerts(spark, d).select("alert_pk", "market_pk", "created_us", "severity")
    return reads.filled(rows.where("severity = 'critical' AND score >= 99"), rows.where("severity = 'high'"), "created_us", "alert_pk", 40).select("alert_pk", "severity", "source")


def top_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts(spark, d).orderBy(F.desc("score"), F.desc("created_us"), "alert_pk").limit(60).select("alert_pk", "market_pk", "score")


def book_markets(spark: SparkSession, d: str) -> DataFrame:
    """Markets to watch in depth: active ones by volume, or any where none has traded lately."""
    volume = src.trades(spark, d).groupBy("market_pk").agg(F.sum("count").cast("double").alias("volume"), F.max("ts_us").alias("last_us"))
    rows = listed(spark, d).join(volume, "market_pk", "left")
    live = rows.where(F.col("status").isin("active", "open", "unknown") & (F.col("last_us") >= src.ORIGIN_US + 2_000_000_000))
    spare = rows.where(F.col("status").isin("active", "open") & (F.col("close_us") > NOW))
    return reads.first_nonempty(live, spare, [F.desc_nulls_last("volume"), F.desc("updated_us"), F.col("market_pk")], 50).select("market_pk", "volume", "fallback")


def hydration_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Unknown markets by their prints, the busiest 100."""
    counts = src.trades(spark, d).groupBy("market_pk").agg(F.count("*").alias("prints"))
    unknown = listed(spark, d).where("status = 'unknown'").select("market_pk").join(counts, "market_pk", "left").fillna(0, ["prints"])
    return unknown.orderBy(F.desc("prints"), "market_pk").limit(100)


def backfill_markets(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 20 markets by volume, prints and freshness."""
    volume = src.trades(spark, d).groupBy("market_pk").agg(F.sum("count").cast("double").alias("volume"), F.count("*").alias("prints"), F.max("ts_us").alias("last_us"))
    rows = src.markets(spark, d).select("market_pk").join(volume, "market_pk", "left")
    order = [F.desc_nulls_last(c) for c in ("volume", "prints", "last_us")]
    return rows.orderBy(*order, "market_pk").offset(40).limit(20).select("market_pk", "volume", "prints")


def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 markets to audit: those with null status first, then unknown, then active ones past their close."""
    rows = listed(spark, d)
    return reads.ordered_union([rows.where("status IS NULL"), rows.where("status = 'unknown'"), rows.where((F.col("status") == "active") & (F.col("close_us") <= NOW))], "market_pk", 100)


def book_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Book events that are left after those older than ten minutes before the tape's end are gone."""
    left = src.book_events(spark, d).where(F.col("received_us") >= src.ORIGIN_US + 1_992_000_000)
    return left.groupBy("market_pk").agg(F.count("*").alias("events"))


def raw_store(spark: SparkSession, d: str) -> DataFrame:
    """Prints in whole cents (0 to 255) and contracts with their tier, as written to the raw store."""
    cents = F.greatest(F.lit(0), F.least(F.lit(255), filters.cents(F.col("yes_price"))))
    rows = src.trades(spark, d).select("market_pk", "trade_pk", cents.alias("cents"), F.greatest(F.lit(0), filters.contracts(F.col("count"))).cast("long").alias("contracts"))
    return rows.join(tiers(spark, d).select("market_pk", "tier"), "market_pk", "left")


def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """One document per market for a text index: words, counters and scores together."""
    counts = stats.trade_stats(src.trades(spark, d)).select("market_pk", "trade_count")
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "category", "event_id")), F.lit("[a-z0-9]{3,}"), F.lit(0))))
    return listed(spark, d).join(counts, "market_pk", "left").select("market_pk", F.array_join(terms, " ").alias("terms"), F.coalesce("trade_count", F.lit(0)).alias("trade_count"), "status")


def market_history(spark: SparkSession, d: str) -> DataFrame:
    """Bars of market 3 in the first half hour, newest first, 500 at most."""
    from tapeglass.operators import bars

    rows = bars.price_bars(src.trades(spark, d), src.quotes(spark, d), 300).where((F.col("market_pk") == 3) & (F.col("bucket") < src.ORIGIN_US // 1_000_000 + 1800))
    return rows.orderBy(F.desc("bucket")).limit(500).select("market_pk", "bucket", "close_price")


QUERIES = {
    f.__name__: f
    for f in (
        market_filters, market_search, resolved_quotes, news_signals, weak_links, recent_articles, baseline_run, alert_stats, alert_counters, market_metrics, signal_history, retention_counts,
        prune_summary, cascaded_prints, job_states, pipeline_summary, source_counts, display_series, trade_highlights, event_news, status_audit, recent_alerts, filled_alerts, top_alerts, book_markets,
        hydration_backlog, backfill_markets, audit_sample, book_expiry, raw_store, search_documents, market_history,
    )
}

LISTED_SQL = f"""{src.MARKETS_SQL},
listed AS (
  SELECT market_pk, market_id, event_id, category, prior, close_us,
    CASE WHEN market_pk % 5 = 0 THEN market_id ELSE 'Will ' || array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(event_id, ' ')], ' ') || ' decide ' || category || '?' END AS title,
    CASE WHEN market_pk % 11 = 0 THEN 'unknown' WHEN market_pk % 13 = 0 THEN NULL ELSE status END AS status, {src.ORIGIN_US} + market_pk % 96 * {HOUR_US} AS updated_us FROM markets
)"""
ALERTS_SQL = """alerts AS (
  SELECT user_id AS market_pk, event_id AS alert_pk, epoch_us(ts) AS created_us, value AS score,
    CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity FROM events)"""
CENTS_SQL = f"""cq AS (
  SELECT market_pk, ts_us, CAST(round(CAST(yes_bid AS DECIMAL(18,6)) * 100, 0) AS INT) AS yes_bid_cents, CAST(round(CAST(yes_ask AS DECIMAL(18,6)) * 100, 0) AS INT) AS yes_ask_cents,
    CAST(round(CAST(last_price AS DECIMAL(18,6)) * 100, 0) AS INT) AS last_price_cents FROM ({SQL["latest_quotes"]}))"""
SCORED_LINKS_SQL = f"""{LINKS_SQL}, {src.MARKETS_SQL},
lr AS (
  SELECT n.news_id, n.market_pk, n.news_us, event_id, round(relevance * 10, 6) AS score, CASE news_id % 3 WHEN 0 THEN 'supports_yes' WHEN 1 THEN 'supports_no' ELSE 'ambiguous' END AS label,
    news_id % 3 = 2 AND news_id % 2 = 0 AND news_id % 4 = 0 AS weak FROM links n LEFT JOIN markets m ON m.market_pk = n.market_pk
)"""
STATES_SQL = f"""log AS (
  SELECT event_type || '-' || CAST(user_id % 4 AS VARCHAR) AS key, CASE WHEN value > 80 THEN 'error' WHEN value > 20 THEN 'success' ELSE 'running' END AS status, epoch_us(ts) AS at_us, event_id,
    CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS n, CASE WHEN value > 80 THEN 'e' || CAST(event_id AS VARCHAR) END AS error FROM events
),
states AS (
  SELECT key, arg_max(status, at_us) AS status, max(at_us) AS latest_us, arg_max(n, at_us) FILTER (n IS NOT NULL) AS count, max(at_us) FILTER (status = 'success') AS last_success_us,
    max(at_us) FILTER (status = 'error') AS last_error_us, arg_max(error, at_us) FILTER (error IS NOT NULL) AS last_error, count(*) AS beats, count(*) FILTER (status = 'success') AS successes,
    count(*) FILTER (status = 'error') AS errors FROM log GROUP BY key
),
job AS (
  SELECT *, CASE WHEN status = 'error' THEN 'error' WHEN coalesce(count <= 0, false) THEN 'empty' WHEN {src.ORIGIN_US + 30 * DAY_US} - latest_us > {6 * HOUR_US} THEN 'stale' ELSE 'healthy' END AS health FROM states
)"""
VICTIMS_SQL = "gone AS (SELECT market_pk, category, prior FROM listed WHERE coalesce(category IN ('exotic_combo', 'crypto_strike'), false) OR coalesce(prior = 'very_low', false) OR coalesce(status = 'unknown' AND title = market_id, false))"

READING_SQL: dict[str, str] = {
    "market_filters": f"""WITH {LISTED_SQL}
SELECT market_pk, coalesce(status NOT IN ('unknown', 'out_of_scope') AND title <> market_id, false) AS hydrated, coalesce(status <> 'unknown' AND title <> market_id, false) AND category <> 'exotic_combo' AS news_linkable,
  title <> market_id AND coalesce(status, '') <> 'unknown' AND category <> 'exotic_combo' AS profile_candidate,
  coalesce(status = 'active', false) AND close_us > {NOW} AND market_pk % 17 <> 0 AS active, NOT coalesce(status = 'active', false) OR close_us <= {NOW} OR market_pk % 17 = 0 AS historical,
  prior = 'very_low' AS out_of_scope, coalesce(status IN ('active', 'unknown'), false) AND prior <> 'very_low' AS quoted, status = 'unknown' AND title = market_id AS stale_stub,
  close_us <= {NOW - DAY_US} OR coalesce(status = 'closed' AND updated_us <= {NOW - DAY_US}, false) AS closed_long, prior AS priority FROM listed""",
    "market_search": f"""WITH {LISTED_SQL}
SELECT market_pk, title FROM listed WHERE (title ILIKE '%ma%' OR market_id ILIKE '%ma%' OR event_id ILIKE '%ma%') AND market_pk IN (SELECT user_id FROM events)""",
    "resolved_quotes": f"""WITH {CENTS_SQL}, s AS (SELECT *, coalesce(CAST(last_price_cents AS DOUBLE), (yes_bid_cents + yes_ask_cents) / 2, yes_bid_cents, yes_ask_cents) AS shown FROM cq)
SELECT market_pk, ts_us, yes_bid_cents, yes_ask_cents, last_price_cents, shown <= 5 OR shown >= 95 OR (yes_bid_cents <= 5 AND yes_ask_cents >= 95) AS resolved FROM s""",
    "news_signals": f"""WITH {SCORED_LINKS_SQL}, best AS (SELECT * FROM lr WHERE score >= 4 ORDER BY score DESC, news_us DESC, news_id DESC, market_pk LIMIT 5000)
SELECT news_id, market_pk, event_id, score, label FROM best WHERE NOT weak AND label <> 'ambiguous'
QUALIFY row_number() OVER (PARTITION BY news_id, event_id ORDER BY score DESC, news_us DESC, news_id DESC, market_pk) = 1 ORDER BY score DESC, news_us DESC, news_id DESC, market_pk LIMIT 50""",
    "weak_links": f"WITH {SCORED_LINKS_SQL} SELECT label, weak, count(*) AS links FROM lr GROUP BY label, weak",
    "recent_articles": f"""WITH {src.ARTICLES_SQL}, a AS (SELECT article_id, CASE WHEN article_id % 9 > 0 THEN first_seen_us END AS first_seen_us FROM articles)
SELECT * FROM a WHERE first_seen_us IS NULL OR first_seen_us BETWEEN {src.ORIGIN_US} AND {src.ORIGIN_US + DAY_US}""",
    "baseline_run": f"""WITH {src.TRADES_SQL}, {src.MARKETS_SQL},
r AS (SELECT * FROM trades WHERE ts_us >= {src.ORIGIN_US + 800_000_000} ORDER BY ts_us, trade_pk LIMIT 5000),
e AS (SELECT coalesce(m.category, 'unclassified') AS category, unnest(list_distinct([coalesce(m.event_id, '*'), '*'])) AS subcategory, CAST(cnt AS DOUBLE) AS c FROM r LEFT JOIN markets m ON m.market_pk = r.market_pk),
b AS (SELECT category, subcategory, count(*) FILTER (c > 0) AS sample_size, round(quantile_cont(c, 0.95) FILTER (c > 0), 6) AS count_p95 FROM e GROUP BY ALL HAVING count(*) FILTER (c > 0) >= 12),
o AS (SELECT DISTINCT category, '*' AS subcategory FROM markets)
SELECT coalesce(b.category, o.category) AS category, coalesce(b.subcategory, o.subcategory) AS subcategory, coalesce(sample_size, 0) AS sample_size, coalesce(count_p95, 0.0) AS count_p95,
  CASE WHEN b.category IS NULL THEN 1 ELSE 2 END AS version FROM o FULL JOIN b ON o.category = b.category AND o.subcategory = b.subcategory""",
    "alert_stats": f"WITH {ALERTS_SQL} SELECT market_pk, count(*) AS alerts, count(*) FILTER (severity IN ('high', 'critical')) AS high_alerts, max(created_us) AS last_alert_us FROM alerts GROUP BY market_pk",
    "market_metrics": f"""WITH {src.TRADES_SQL}, {src.MARKETS_SQL}, {ALERTS_SQL}, {CENTS_SQL},
t AS (SELECT market_pk, count(*) AS trade_count, max(ts_us) AS last_trade_us, CAST(sum(cnt) AS DOUBLE) AS contracts FROM trades GROUP BY market_pk),
a AS (SELECT market_pk, count(*) AS n, count(*) FILTER (severity IN ('high', 'critical')) AS high_alerts, max(created_us) AS last_alert_us FROM alerts GROUP BY market_pk)
SELECT m.market_pk, cq.ts_us AS quote_us, yes_bid_cents, yes_ask_cents, last_price_cents, coalesce(trade_count, 0) AS trade_count, last_trade_us, coalesce(contracts, 0) AS contracts, coalesce(n, 0) AS alerts,
  coalesce(high_alerts, 0) AS high_alerts, last_alert_us, CAST(least(100, round_even(100 * ln(1 + coalesce(n, 0)) / ln(51), 0)) AS INT) AS evidence,
  CAST(least(100, round_even(100 * (1 - exp(-(CASE WHEN n > 0 THEN (8 + 0.4 * (CASE prior WHEN 'very_low' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'medium_high' THEN 3 ELSE 4 END + 1)) * ln(1 + n) ELSE 0 END) / 24)), 0)) AS INT) AS urgency
FROM markets m LEFT JOIN cq ON cq.market_pk = m.market_pk LEFT JOIN t ON t.market_pk = m.market_pk LEFT JOIN a ON a.market_pk = m.market_pk""",
    "signal_history": f"""WITH s AS ({SQL["tape_scores"]}), {src.TRADES_SQL}, {ALERTS_SQL}, {SCORED_LINKS_SQL},
f AS (SELECT s.market_pk, s.trade_pk, s.score, ts_us, row_number() OVER (PARTITION BY s.market_pk ORDER BY s.score DESC, s.trade_pk) AS place FROM s JOIN trades USING (trade_pk) WHERE s.score >= 0.3),
n AS (SELECT market_pk, news_id, score, row_number() OVER (PARTITION BY market_pk ORDER BY score DESC, news_id) AS place FROM lr WHERE label <> 'ambiguous' AND score > 0),
ft AS (SELECT market_pk, max(score) AS best_flag, string_agg(CAST(trade_pk AS VARCHAR), ',' ORDER BY place) AS top_flag FROM f WHERE place <= 5 GROUP BY market_pk),
nt AS (SELECT market_pk, max(score) AS best_news, string_agg(CAST(news_id AS VARCHAR), ',' ORDER BY place) AS top_news FROM n WHERE place <= 5 GROUP BY market_pk),
a AS (SELECT market_pk, count(*) AS alerts, count(*) FILTER (severity IN ('high', 'critical')) AS high_alerts FROM alerts GROUP BY market_pk),
c AS (SELECT f.market_pk, count(*) AS k FROM f JOIN markets m ON m.market_pk = f.market_pk WHERE ts_us < close_us GROUP BY f.market_pk),
j AS (
  SELECT m.market_pk, coalesce(best_flag, 0) AS best_flag, top_flag, coalesce(best_news, 0) AS best_news, top_news, coalesce(alerts, 0) AS alerts, coalesce(high_alerts, 0) AS high_alerts, coalesce(k, 0) AS flags_before_close
  FROM markets m LEFT JOIN ft USING (market_pk) LEFT JOIN nt USING (market_pk) LEFT JOIN a USING (market_pk) LEFT JOIN c USING (market_pk) WHERE close_us <= {NOW}
)
SELECT *, CASE WHEN best_flag >= 8 AND best_news > 0 THEN 'strong_pre_news_review' WHEN best_flag >= 8 THEN 'strong_trade_review' WHEN best_news > 0 THEN 'pre_news_review' WHEN high_alerts > 0 THEN 'quote_book_review'
  WHEN best_flag >= 5 OR alerts > 0 THEN 'weak_review' ELSE 'quiet' END AS label FROM j""",
    "retention_counts": f"""WITH p AS ({SQL["prune_plan"]}), {TIERS_SQL},
c AS (SELECT tier, count(*) AS prints, count(*) FILTER (pruned) AS prunable FROM p GROUP BY tier)
SELECT t.tier, count(*) AS markets, max(ttl_hours) AS ttl_hours, coalesce(any_value(prints), 0) AS prints, coalesce(any_value(prunable), 0) AS prunable FROM tiers t LEFT JOIN c ON c.tier = t.tier GROUP BY t.tier""",
    "prune_summary": f"""WITH {LISTED_SQL}, {VICTIMS_SQL}
SELECT category, prior, count(*) AS markets, CAST(coalesce(sum(n), 0) AS BIGINT) AS prints FROM gone LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = market_pk GROUP BY category, prior""",
    "cascaded_prints": f"WITH {LISTED_SQL}, {VICTIMS_SQL} SELECT user_id AS market_pk, count(*) AS prints FROM events WHERE user_id NOT IN (SELECT market_pk FROM gone) GROUP BY user_id",
    "job_states": f"WITH {STATES_SQL} SELECT * FROM job",
    "pipeline_summary": f"""WITH {STATES_SQL}, c AS (SELECT count(*) FILTER (health = 'healthy') AS healthy, count(*) FILTER (health = 'stale') AS stale, count(*) FILTER (health = 'empty') AS empty, count(*) FILTER (health = 'error') AS error FROM job)
SELECT *, CASE WHEN error > 0 THEN 'error' WHEN stale > 0 THEN 'stale' WHEN healthy > 0 THEN 'healthy' ELSE 'empty' END AS overall FROM c""",
    "source_counts": f"""WITH {LINKS_SQL}, p AS (SELECT news_id, count(DISTINCT market_pk) AS linked FROM links WHERE relevance >= 0.45 GROUP BY news_id)
SELECT domain, count(*) AS articles, CAST(coalesce(sum(linked), 0) AS BIGINT) AS linked, max(first_seen_us) AS latest_us, CASE WHEN length(domain) % 2 = 0 THEN 'official' ELSE 'broad' END AS tier
FROM articles LEFT JOIN p ON news_id = article_id GROUP BY domain""",
    "display_series": f"""WITH {src.TRADES_SQL}, {src.QUOTES_SQL},
o AS (SELECT market_pk, ts_us // 1000000 AS unix, yes_price AS v, 3 AS r FROM trades UNION ALL SELECT market_pk, ts_us // 1000000, coalesce(last_price, (yes_bid + yes_ask) / 2), 2 FROM quotes),
s AS (SELECT market_pk, unix, max({{'r': r, 'v': v}}).v AS v FROM o GROUP BY market_pk, unix),
b AS (SELECT market_pk, min(unix) // 60 * 60 AS lo, (max(unix) + 59) // 60 * 60 AS hi FROM s GROUP BY market_pk),
g AS (SELECT market_pk, unnest(generate_series(lo, hi, 60)) AS at FROM b),
d AS (SELECT market_pk, unix // 60 * 60 AS at, arg_max(v, unix) AS direct FROM s GROUP BY ALL),
pre AS (SELECT g.market_pk, g.at, s.unix AS u0, s.v AS v0 FROM g ASOF LEFT JOIN s ON s.market_pk = g.market_pk AND g.at > s.unix),
nxt AS (SELECT g.market_pk, g.at, s.unix AS u1, s.v AS v1 FROM g ASOF LEFT JOIN s ON s.market_pk = g.market_pk AND g.at <= s.unix)
SELECT pre.market_pk, pre.at, round(least(1.0, greatest(0.0, coalesce(direct, v0 + (v1 - v0) * (pre.at - u0) / (u1 - u0), v0, v1))), 6) AS value
FROM pre JOIN nxt USING (market_pk, "at") LEFT JOIN d USING (market_pk, "at")""",
    "trade_highlights": f"""WITH {src.TRADES_SQL},
z AS (SELECT market_pk, list_sort(list(CAST(cnt AS DOUBLE)) FILTER (cnt > 0)) AS l FROM trades GROUP BY market_pk),
p AS (SELECT market_pk, l[least(len(l) - 1, CAST(floor(len(l) * CAST(0.9 AS DOUBLE)) AS INT)) + 1] AS p90 FROM z),
t AS (SELECT *, round(yes_price - lag(yes_price) OVER (PARTITION BY market_pk ORDER BY ts_us, trade_pk), 9) AS delta FROM trades)
SELECT t.market_pk, trade_pk, CAST(cnt AS DOUBLE) >= greatest(25.0, coalesce(p90, 0)) AS big_size, coalesce(abs(delta) >= 0.08, false) AS big_jump, delta FROM t JOIN p ON p.market_pk = t.market_pk""",
    "event_news": f"""WITH {LINKS_SQL}, {src.MARKETS_SQL}
SELECT n.market_pk, news_id, domain, category, CAST(row_number() OVER (PARTITION BY n.market_pk ORDER BY n.news_us DESC, news_id DESC) AS INT) AS place
FROM links n JOIN articles ON article_id = news_id JOIN markets m ON m.market_pk = n.market_pk WHERE relevance >= 0.45 QUALIFY place <= 25""",
    "status_audit": f"""WITH {LISTED_SQL}, u AS (SELECT market_pk, CASE WHEN market_pk % 8 = 0 THEN 'settled' ELSE status END AS theirs FROM markets WHERE market_pk % 10 > 0)
SELECT count(*) AS checked, count(*) FILTER (theirs IS NULL) AS missing, count(*) FILTER (theirs IS NOT NULL AND status IS DISTINCT FROM theirs) AS mismatched,
  count(*) FILTER (theirs IN ('closed', 'settled', 'finalized') AND status = 'active') AS final_but_active FROM listed LEFT JOIN u USING (market_pk)""",
    "recent_alerts": f"""WITH {ALERTS_SQL}, {src.MARKETS_SQL}
SELECT alert_pk, a.market_pk, severity, category FROM alerts a JOIN markets m ON m.market_pk = a.market_pk WHERE status = 'active' ORDER BY created_us DESC, alert_pk LIMIT 50""",
    "filled_alerts": f"""WITH {ALERTS_SQL}, u AS (SELECT alert_pk, created_us, severity, 0 AS source FROM alerts WHERE score >= 99 UNION ALL SELECT alert_pk, created_us, severity, 1 FROM alerts WHERE severity = 'high')
SELECT alert_pk, severity, source FROM u ORDER BY source, created_us DESC, alert_pk LIMIT 40""",
    "top_alerts": f"WITH {ALERTS_SQL} SELECT alert_pk, market_pk, score FROM alerts ORDER BY score DESC, created_us DESC, alert_pk LIMIT 60",
    "book_markets": f"""WITH {src.TRADES_SQL}, {LISTED_SQL}, v AS (SELECT market_pk, CAST(sum(cnt) AS DOUBLE) AS volume, max(ts_us) AS last_us FROM trades GROUP BY market_pk),
r AS (SELECT * FROM listed LEFT JOIN v USING (market_pk)),
a AS (SELECT market_pk, volume, updated_us, false AS fallback FROM r WHERE status IN ('active', 'open', 'unknown') AND last_us >= {src.ORIGIN_US + 2_000_000_000}),
b AS (SELECT market_pk, volume, updated_us, true FROM r WHERE status IN ('active', 'open') AND close_us > {NOW} AND NOT EXISTS (SELECT 1 FROM a))
SELECT market_pk, volume, fallback FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY volume DESC NULLS LAST, updated_us DESC, market_pk LIMIT 50""",
    "hydration_backlog": f"""WITH {LISTED_SQL}, c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT market_pk, coalesce(n, 0) AS prints FROM listed LEFT JOIN c ON user_id = market_pk WHERE status = 'unknown' ORDER BY prints DESC, market_pk LIMIT 100""",
    "backfill_markets": f"""WITH {src.TRADES_SQL}, {src.MARKETS_SQL}, v AS (SELECT market_pk, CAST(sum(cnt) AS DOUBLE) AS volume, count(*) AS prints, max(ts_us) AS last_us FROM trades GROUP BY market_pk)
SELECT m.market_pk, volume, prints FROM markets m LEFT JOIN v ON v.market_pk = m.market_pk ORDER BY volume DESC NULLS LAST, prints DESC NULLS LAST, last_us DESC NULLS LAST, m.market_pk LIMIT 20 OFFSET 40""",
    "audit_sample": f"""WITH {LISTED_SQL}
SELECT market_pk, CASE WHEN status IS NULL THEN 0 WHEN status = 'unknown' THEN 1 ELSE 2 END AS part FROM listed WHERE status IS NULL OR status = 'unknown' OR (status = 'active' AND close_us <= {NOW}) ORDER BY part, market_pk LIMIT 100""",
    "book_expiry": f"WITH {src.BOOK_SQL} SELECT market_pk, count(*) AS events FROM book WHERE received_us >= {src.ORIGIN_US + 1_992_000_000} GROUP BY market_pk",
    "raw_store": f"""WITH {TIERS_SQL}
SELECT t.market_pk, trade_pk, CAST(greatest(0, least(255, round(CAST(yes_price AS DECIMAL(18,6)) * 100, 0))) AS INT) AS cents, CAST(greatest(0, round(cnt, 0)) AS BIGINT) AS contracts, tier FROM trades t LEFT JOIN tiers ON tiers.market_pk = t.market_pk""",
    "search_documents": f"""WITH {LISTED_SQL}, c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT market_pk, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title || ' ' || category || ' ' || event_id), '[a-z0-9]{{3,}}'))), ' ') AS terms, coalesce(n, 0) AS trade_count, status
FROM listed LEFT JOIN c ON user_id = market_pk""",
    "market_history": f"SELECT market_pk, bucket, close_price FROM ({SQL['price_bars']}) WHERE market_pk = 3 AND bucket < {src.ORIGIN_US // 1_000_000 + 1800} ORDER BY bucket DESC LIMIT 500",
}
READING_SQL["alert_counters"] = READING_SQL["alert_stats"]
