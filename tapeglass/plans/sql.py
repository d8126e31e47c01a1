"""The queries of :mod:`tapeglass.plans.queries` as SQL over the raw tables."""

from __future__ import annotations

from tapeglass.functions.scores import SIGNALS
from tapeglass.operators.classify import CATEGORIES, PRIOR_OF, TAG_RULES
from tapeglass.operators.news import SAME_WORD, STOPWORDS
from tapeglass.operators.retention import DAY_US, PRE_NEWS_PRINTS, PRE_NEWS_RELEVANCE, PRE_NEWS_SHARE
from tapeglass.sources.adapters import ARTICLES_SQL, BOOK_SQL, MARKETS_SQL, NOW_US, ORIGIN_US, QUOTES_SQL, TRADES_SQL

OTHER_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAME_WORD.items()) + " ELSE {0} END"


def bars_sql(interval: int) -> str:
    return f"""WITH {TRADES_SQL}, {QUOTES_SQL},
points AS (
  SELECT market_pk, ts_us, yes_price AS price, 3 AS rnk, CAST(NULL AS DOUBLE) AS bid, CAST(NULL AS DOUBLE) AS ask, NULL AS vol, false AS q, cnt FROM trades
  UNION ALL
  SELECT market_pk, ts_us, coalesce(last_price, (yes_bid + yes_ask) / 2), CASE WHEN last_price IS NOT NULL THEN 2 ELSE 1 END, yes_bid, yes_ask, volume, true, 0 FROM quotes
)
SELECT market_pk, ts_us // {interval}000000 * {interval} AS bucket,
  arg_min(price, ts_us * 2 + CAST(q AS INT)) AS open_price, max(price) AS high_price, min(price) AS low_price,
  arg_max(price, rnk * 10000000000000000 + ts_us) AS close_price, CAST(max(rnk) AS INT) AS close_rank,
  arg_min(bid, ts_us) FILTER (q) AS open_bid, max(bid) AS high_bid, min(bid) AS low_bid, arg_max(bid, ts_us) FILTER (q) AS close_bid,
  arg_min(ask, ts_us) FILTER (q) AS open_ask, max(ask) AS high_ask, min(ask) AS low_ask, arg_max(ask, ts_us) FILTER (q) AS close_ask,
  min(ts_us) AS first_price_us, max(ts_us) AS last_price_us, min(ts_us) FILTER (q) AS first_quote_us, max(ts_us) FILTER (q) AS last_quote_us,
  count(*) FILTER (NOT q) AS trade_count, count(*) FILTER (q) AS quote_count, CAST(sum(cnt) AS DOUBLE) AS trade_volume,
  CAST(arg_max(vol, ts_us) FILTER (q) AS DOUBLE) AS close_volume
FROM points GROUP BY ALL"""


def robust(value: str) -> str:
    return f"""CASE WHEN {value} IS NULL OR len({value}_past) < 3 THEN 0.0
      WHEN {value}_mad > 1e-12 THEN least(6.0, abs({value} - {value}_mid) / (1.4826 * {value}_mad))
      WHEN list_aggregate({value}_past, 'stddev_samp') > 1e-9 THEN least(6.0, abs({value} - {value}_mid) / list_aggregate({value}_past, 'stddev_samp')) ELSE 0.0 END"""


BURST_SQL = f"""{TRADES_SQL},
bursts AS (
  SELECT market_pk, trade_pk, ts_us, count(*) OVER w AS window_count, count(*) FILTER (taker_side = 'yes') OVER w AS yes_count,
         count(*) FILTER (taker_side = 'no') OVER w AS no_count, row_number() OVER (PARTITION BY market_pk ORDER BY ts_us, trade_pk) AS place
  FROM trades WINDOW w AS (PARTITION BY market_pk ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 30000000 FOLLOWING)
)"""

LINKS_SQL = f"""{ARTICLES_SQL},
links AS (
  SELECT article_id AS news_id, article_id % (SELECT max(user_id) + 1 FROM events) AS market_pk, first_seen_us AS news_us,
         (article_id * 37 % 100) / CAST(100 AS DOUBLE) AS relevance FROM articles
)"""


def news_sql(hours: int, least: float, after: bool) -> str:
    gap = "n.news_us - t.ts_us" if after else "t.ts_us - n.news_us"
    return f"""WITH {TRADES_SQL}, {LINKS_SQL},
met AS (
  SELECT trade_pk, news_id, {gap} AS gap FROM trades t JOIN links n ON n.market_pk = t.market_pk AND n.relevance >= {least} AND {gap} BETWEEN 0 AND {hours * 3_600_000_000}
),
best AS (SELECT trade_pk, arg_min(news_id, gap * 1000000 + news_id) AS news_id, min(gap) AS gap FROM met GROUP BY trade_pk)
SELECT market_pk, t.trade_pk, news_id, round(gap / CAST(3600000000 AS DOUBLE), 6) AS hours_apart FROM trades t LEFT JOIN best USING (trade_pk)"""


TIERS_SQL = f"""{TRADES_SQL}, {MARKETS_SQL}, {BOOK_SQL}, {LINKS_SQL},
sums AS (
  SELECT market_pk, sum(cnt) AS v, sum(cnt) FILTER (taker_side = 'yes') AS oi, max(cnt) > 90 AS has_alert,
    abs(arg_max(yes_price, {{'a': ts_us, 'b': trade_pk}}) - avg(yes_price)) / CASE WHEN stddev_pop(yes_price) > 0 THEN stddev_pop(yes_price) END AS zscore FROM trades GROUP BY market_pk
),
severe AS (
  SELECT DISTINCT user_id AS market_pk, true AS severe FROM events WHERE value >= 40 AND epoch_us(ts) > {NOW_US - DAY_US} AND epoch_us(ts) <= {NOW_US}
),
bursts AS (SELECT market_pk, max(n) / avg(n) AS burst FROM (SELECT market_pk, count(*) AS n FROM trades GROUP BY market_pk, ts_us // 60000000) GROUP BY market_pk),
best_news AS (SELECT market_pk, max(relevance) AS news FROM links GROUP BY market_pk),
leans AS (
  SELECT l.market_pk, count(*) >= {PRE_NEWS_PRINTS} AND abs(sum(CASE taker_side WHEN 'yes' THEN cnt WHEN 'no' THEN -cnt ELSE 0 END)) >= {PRE_NEWS_SHARE} * sum(cnt) AS leaned
  FROM links l JOIN trades t ON t.market_pk = l.market_pk AND ts_us >= news_us - {DAY_US} AND ts_us < news_us WHERE relevance >= {PRE_NEWS_RELEVANCE} GROUP BY l.market_pk, news_id
),
moves AS (SELECT market_pk, bool_or(leaned) AS move FROM leans GROUP BY market_pk),
pulls AS (
  SELECT market_pk, max(pulled / greatest(added, 1.0)) AS pull FROM (
    SELECT market_pk, CAST(coalesce(sum(delta) FILTER (delta > 0), 0) AS DOUBLE) AS added, CAST(coalesce(-sum(delta) FILTER (delta < 0), 0) AS DOUBLE) AS pulled
    FROM book WHERE NOT is_snapshot GROUP BY market_pk, received_us // 60000000) GROUP BY market_pk
),
signals AS (
  SELECT m.market_pk, prior, close_us, list_filter([
    CASE WHEN prior IN ('high', 'medium_high') THEN 'high_prior' END, CASE WHEN prior = 'medium' THEN 'medium_prior' END,
    CASE WHEN close_us > {NOW_US} AND close_us <= {NOW_US + 14 * DAY_US} THEN 'closing_soon' END,
    CASE WHEN v >= 250 THEN 'volume_24h_floor' END, CASE WHEN oi >= 200 THEN 'open_interest_floor' END,
    CASE WHEN has_alert THEN 'materialized_anomaly' END, CASE WHEN severe THEN 'severe_anomaly' END, CASE WHEN zscore >= 3 THEN 'price_zscore' END,
    CASE WHEN burst >= 3 THEN 'trade_burst' END, CASE WHEN news >= 0.75 THEN 'news_match' END, CASE WHEN move THEN 'pre_news_directional_move' END,
    CASE WHEN pull >= 3 THEN 'l2_pull' END], lambda x: x IS NOT NULL) AS reasons
  FROM markets m LEFT JOIN sums USING (market_pk) LEFT JOIN severe USING (market_pk) LEFT JOIN bursts USING (market_pk) LEFT JOIN best_news USING (market_pk)
    LEFT JOIN moves USING (market_pk) LEFT JOIN pulls USING (market_pk)
),
scored AS (
  SELECT *, coalesce(list_sum([CASE r {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SIGNALS.items())} END FOR r IN reasons]), 0) AS score FROM signals
),
tiers AS (
  SELECT market_pk, prior, close_us, reasons, CAST(score AS INT) AS score,
    CASE WHEN score >= 110 THEN 'case' WHEN score >= 80 THEN 'triggered' WHEN score >= 50 THEN 'hot' WHEN score >= 20 THEN 'sampled' ELSE 'observe_only' END AS tier,
    CASE WHEN score >= 110 THEN NULL WHEN score >= 80 THEN 720 WHEN score >= 50 THEN 168 WHEN score >= 20 THEN 24 ELSE 1 END AS ttl_hours,
    CAST(CASE WHEN score >= 50 THEN 1.0 WHEN score >= 20 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS sample_rate
  FROM scored
)"""

SQL: dict[str, str] = {
    "price_bars": bars_sql(300),
    "hourly_bars": bars_sql(3600),
    "side_volume": f"""WITH {TRADES_SQL}
SELECT market_pk, ts_us // 300000000 * 300 AS bucket, CAST(coalesce(sum(cnt) FILTER (taker_side = 'yes'), 0) AS DOUBLE) AS yes_volume,
  CAST(coalesce(sum(cnt) FILTER (taker_side = 'no'), 0) AS DOUBLE) AS no_volume, CAST(coalesce(sum(cnt) FILTER (taker_side IS NULL), 0) AS DOUBLE) AS other_volume
FROM trades GROUP BY ALL""",
    "minute_features": f"""WITH {TRADES_SQL}, {QUOTES_SQL}, {BOOK_SQL},
p AS (SELECT market_pk, ts_us // 60000000 * 60 AS bucket, count(*) AS trade_count, sum(cnt) AS volume, max(cnt) AS max_size, arg_min(yes_price, ts_us) AS first_price,
        arg_max(yes_price, ts_us) AS last_price, min(yes_price) AS min_price, max(yes_price) AS max_price FROM trades GROUP BY ALL),
q AS (SELECT market_pk, ts_us // 60000000 * 60 AS bucket, count(*) AS quote_updates, max(yes_ask - yes_bid) AS max_spread FROM quotes GROUP BY ALL),
b AS (SELECT market_pk, received_us // 60000000 * 60 AS bucket, coalesce(sum(delta) FILTER (delta > 0), 0) AS added, coalesce(-sum(delta) FILTER (delta < 0), 0) AS cancelled
      FROM book WHERE NOT is_snapshot GROUP BY ALL)
SELECT market_pk, bucket, coalesce(trade_count, 0) AS trade_count, CAST(coalesce(volume, 0) AS DOUBLE) AS volume, CAST(coalesce(max_size, 0) AS DOUBLE) AS max_size,
  first_price, last_price, min_price, max_price, coalesce(quote_updates, 0) AS quote_updates, round(max_spread, 9) AS max_spread,
  CAST(coalesce(added, 0) AS DOUBLE) AS added, CAST(coalesce(cancelled, 0) AS DOUBLE) AS cancelled,
  CASE WHEN coalesce(added + cancelled, 0) > 0 THEN round(CAST(cancelled AS DOUBLE) / CAST(added + cancelled AS DOUBLE), 9) ELSE 0.0 END AS depth_pull_score
FROM p FULL JOIN q USING (market_pk, bucket) FULL JOIN b USING (market_pk, bucket)""",
    "tape_scores": f"""WITH {TRADES_SQL},
a AS (SELECT *, ln(1 + CAST(cnt AS DOUBLE)) AS ls, abs(yes_price - lag(yes_price) OVER (PARTITION BY market_pk ORDER BY ts_us, trade_pk)) AS dp, coalesce(taker_side, '') AS side FROM trades),
b AS (
  SELECT *, list(ls) OVER h AS ls_past, coalesce(list(dp) FILTER (dp IS NOT NULL) OVER h, []) AS dp_past,
    list({{'t': ts_us, 's': side}}) OVER c AS near, count(*) FILTER (side IN ('yes', 'no')) OVER s AS sided,
    count(*) FILTER (side = 'yes') OVER s AS yes_n, count(*) FILTER (side = 'no') OVER s AS no_n
  FROM a WINDOW h AS (PARTITION BY market_pk ORDER BY ts_us, trade_pk ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING),
    c AS (PARTITION BY market_pk ORDER BY ts_us, trade_pk ROWS BETWEEN 50 PRECEDING AND CURRENT ROW),
    s AS (PARTITION BY market_pk ORDER BY ts_us, trade_pk ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
),
c AS (
  SELECT * REPLACE (coalesce(ls_past, []) AS ls_past), list_aggregate(ls_past, 'median') AS ls_mid, list_aggregate(dp_past, 'median') AS dp_mid,
    [x.s FOR x IN near IF x.t >= ts_us - 30000000] AS recent FROM b
),
d AS (
  SELECT *, list_aggregate([abs(x - ls_mid) FOR x IN ls_past], 'median') AS ls_mad, list_aggregate([abs(x - dp_mid) FOR x IN dp_past], 'median') AS dp_mad,
    len([x FOR x IN recent IF x = side]) / CAST(len(recent) AS DOUBLE) AS same FROM c
),
e AS (
  SELECT *, {robust("ls")} AS size_z, {robust("dp")} AS move_z, least(4.0, coalesce(dp, 0.0) / 0.035) AS raw_move,
    CASE WHEN side IN ('yes', 'no') AND len(recent) >= 3 AND same >= 0.65 THEN least(3.0, (len(recent) - 2) * same / 2) ELSE 0.0 END AS cluster,
    side IN ('yes', 'no') AND sided >= 4 AND (CASE WHEN side = 'yes' THEN yes_n ELSE no_n END) >= 0.9 * sided AS steady,
    greatest(0.0, CAST(cnt AS DOUBLE) * CASE WHEN side = 'no' THEN no_price ELSE yes_price END) AS dollars FROM d
),
f AS (
  SELECT *, cluster >= 1.5 AND NOT steady AS sudden,
    CASE WHEN dollars < 10 THEN 0.03 WHEN dollars < 25 THEN 0.05 WHEN dollars < 100 THEN 0.20 WHEN dollars < 250 THEN 0.45 WHEN dollars < 1000 THEN 1.0
         WHEN dollars < 5000 THEN 1.12 ELSE 1.3 END AS base FROM e
),
g AS (
  SELECT *, CAST(greatest(base, CASE WHEN sudden AND cluster >= 3 AND dollars < 25 THEN 0.35 WHEN sudden AND cluster >= 3 AND dollars < 100 THEN 0.55
      WHEN sudden AND cluster >= 3 AND dollars < 250 THEN 0.75 ELSE 0 END) AS DOUBLE) AS multiplier,
    CASE WHEN size_z >= 1.5 OR raw_move >= 0.5 OR sudden THEN cluster ELSE 0.0 END AS counted FROM f
)
SELECT market_pk, trade_pk, round(least(10.0, (0.45 * size_z + 0.35 * move_z + 0.15 * raw_move + 0.20 * counted) * multiplier / 4.5 * 10.0), 3) AS score,
  round(size_z, 3) AS size_z, round(move_z, 3) AS move_z, round(raw_move, 3) AS raw_move, round(cluster, 3) AS cluster, dollars, multiplier,
  array_to_string([r FOR r IN [CASE WHEN size_z >= 2.5 THEN 'large_size_vs_recent' END, CASE WHEN move_z >= 2.5 OR raw_move >= 2 THEN 'price_jump_vs_recent' END,
    CASE WHEN counted >= 1.5 THEN 'same_side_cluster' END, CASE WHEN dollars < 100 THEN 'low_notional_discount' WHEN dollars < 250 THEN 'modest_notional_discount'
    WHEN dollars < 1000 THEN NULL WHEN dollars < 5000 THEN 'meaningful_notional' ELSE 'large_notional' END,
    CASE WHEN sudden AND cluster >= 3 AND dollars < 250 THEN 'small_bet_cluster' END] IF r IS NOT NULL], ',') AS reasons
FROM g""",
    "tape_bursts": f"""WITH {BURST_SQL}
SELECT market_pk, trade_pk, window_count, yes_count, no_count,
  CASE WHEN window_count >= 2 THEN round(least(10.0, 1.2 * (window_count - 1) * (0.5 + 0.5 * greatest(yes_count, no_count) / CAST(window_count AS DOUBLE))), 3) ELSE 0.0 END AS cluster_score
FROM bursts""",
    "burst_summary": f"""WITH {BURST_SQL},
most AS (SELECT market_pk, max(window_count) AS largest_window FROM bursts GROUP BY market_pk),
best AS (
  SELECT market_pk, arg_max(CASE WHEN yes_count >= no_count THEN 'yes' ELSE 'no' END, greatest(yes_count, no_count) * 1000000000 - place) AS dominant_side
  FROM bursts JOIN most USING (market_pk) WHERE window_count = largest_window AND window_count >= 2 AND yes_count + no_count >= 0.6 * window_count GROUP BY market_pk
)
SELECT market_pk, largest_window, CASE WHEN largest_window > 1 THEN round(least(10.0, 2 * sqrt(largest_window - 1)), 3) ELSE 0.0 END AS burst_score, dominant_side
FROM most LEFT JOIN best USING (market_pk)""",
    "quote_asof": f"""WITH {TRADES_SQL}, {QUOTES_SQL}
SELECT t.market_pk, t.trade_pk, q.ts_us AS quote_us, q.yes_bid, q.yes_ask
FROM trades t ASOF LEFT JOIN quotes q ON t.market_pk = q.market_pk AND t.ts_us >= q.ts_us""",
    "follow_through": f"""WITH {TRADES_SQL},
f AS (
  SELECT market_pk, trade_pk, yes_price, coalesce(first_value(yes_price) OVER (PARTITION BY market_pk ORDER BY ts_us RANGE BETWEEN 300000000 FOLLOWING AND UNBOUNDED FOLLOWING),
    CASE WHEN lead(trade_pk) OVER (PARTITION BY market_pk ORDER BY ts_us) IS NOT NULL THEN
      last_value(yes_price) OVER (PARTITION BY market_pk ORDER BY ts_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END, yes_price) AS later_price FROM trades
)
SELECT market_pk, trade_pk, later_price, round(later_price - yes_price, 9) AS move FROM f""",
    "news_after": news_sql(72, 0.45, True),
    "news_before": news_sql(24, 0.55, False),
    "peer_baselines": f"""WITH {TRADES_SQL}, {MARKETS_SQL},
rows AS (
  SELECT coalesce(m.category, 'unclassified') AS category, unnest(list_distinct([coalesce(m.event_id, '*'), '*'])) AS subcategory, t.market_pk, ts_us, trade_pk, yes_price, CAST(cnt AS DOUBLE) AS c
  FROM trades t LEFT JOIN markets m ON m.market_pk = t.market_pk
),
moved AS (SELECT *, abs(yes_price - lag(yes_price) OVER (PARTITION BY category, subcategory, market_pk ORDER BY ts_us, trade_pk)) AS move FROM rows)
SELECT category, subcategory, count(c) FILTER (c > 0) AS sample_size, round(quantile_cont(c, 0.95) FILTER (c > 0), 6) AS count_p95,
  round(quantile_cont(c, 0.99) FILTER (c > 0), 6) AS count_p99, round(coalesce(quantile_cont(move, 0.95), 0.0), 6) AS move_p95
FROM moved GROUP BY ALL HAVING count(c) FILTER (c > 0) >= 12""",
    "trade_stats": f"""WITH {TRADES_SQL}
SELECT market_pk, count(*) AS trade_count, min(ts_us) AS first_us, max(ts_us) AS last_us, min(yes_price) AS min_price, max(yes_price) AS max_price,
  CAST(sum(cnt) AS DOUBLE) AS contracts, CAST(sum(cnt * CAST(yes_price AS DECIMAL(8,4))) AS DOUBLE) AS dollars FROM trades GROUP BY market_pk""",
    "latest_quotes": f"""WITH {QUOTES_SQL}
SELECT market_pk, quote_pk, ts_us, yes_bid, yes_ask, last_price FROM quotes QUALIFY row_number() OVER (PARTITION BY market_pk ORDER BY ts_us DESC, quote_pk DESC) = 1""",
    "book_activity": f"""WITH {BOOK_SQL},
s AS (
  SELECT market_pk, count(*) AS book_events, count(*) FILTER (NOT is_snapshot) AS book_deltas,
    CAST(coalesce(-sum(delta) FILTER (NOT is_snapshot AND delta < 0), 0) AS DOUBLE) AS pull_volume
  FROM book WHERE received_us BETWEEN {ORIGIN_US + 1_800_000_000 - 180_000_000} AND {ORIGIN_US + 1_800_000_000} GROUP BY market_pk
)
SELECT *, book_events > 400 AS high_churn, pull_volume > 75 AND book_deltas > 30 AS heavy_cancel,
  CAST((CASE WHEN book_events > 400 THEN 1.5 ELSE 0 END) + (CASE WHEN pull_volume > 75 AND book_deltas > 30 THEN 2 ELSE 0 END) AS DOUBLE) AS book_points FROM s""",
    "market_breakdowns": f"""WITH {MARKETS_SQL}, m AS (SELECT coalesce(category, 'unclassified') AS category, coalesce(prior, 'unclassified') AS prior FROM markets)
SELECT 'category' AS kind, category, NULL AS prior, count(*) AS markets FROM m GROUP BY category
UNION ALL SELECT 'prior', NULL, prior, count(*) FROM m GROUP BY prior
UNION ALL SELECT 'category_prior', category, prior, count(*) FROM m GROUP BY category, prior""",
    "top_markets": f"""WITH {TRADES_SQL}, {MARKETS_SQL},
s AS (SELECT market_pk, count(*) AS trade_count, CAST(sum(cnt * CAST(yes_price AS DECIMAL(8,4))) AS DOUBLE) AS dollars, max(ts_us) AS last_us FROM trades GROUP BY market_pk)
SELECT market_pk, trade_count, dollars, last_us, market_id, category, prior FROM s LEFT JOIN markets USING (market_pk) ORDER BY trade_count DESC, market_pk LIMIT 50""",
    "market_lifecycle": f"""WITH {MARKETS_SQL},
n AS (
  SELECT market_pk, category, prior, status, close_us,
    CASE WHEN market_pk % 3 = 0 THEN 'KXEVENT-' || upper(strftime(make_timestamp(close_us), '%y%b%d')) || '-' || CAST(market_pk AS VARCHAR) ELSE market_id END AS market_id FROM markets
),
s AS (
  SELECT *, coalesce(market_pk % 3 = 0 AND epoch_us(strptime(regexp_extract(market_id, '[0-9]{{2}}[A-Z]{{3}}[0-9]{{2}}'), '%y%b%d')) + 108000000000 <= {NOW_US}, false) AS stale
  FROM n WHERE market_pk % 3 = 0
  UNION ALL SELECT *, false FROM n WHERE market_pk % 3 <> 0
)
SELECT market_pk, market_id, stale, CASE WHEN stale THEN 'historical' WHEN status = 'active' AND close_us > {NOW_US} THEN 'active' WHEN close_us <= {NOW_US} THEN 'historical'
    WHEN status <> 'active' THEN 'historical' ELSE 'other' END AS lifecycle, prior <> 'very_low' AS in_scope FROM s""",
    "market_scores": f"""WITH {TRADES_SQL}, {MARKETS_SQL},
j AS (
  SELECT m.market_pk, CASE prior WHEN 'very_low' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'medium_high' THEN 3 ELSE 4 END AS rank, coalesce(n, 0) AS n
  FROM markets m LEFT JOIN (SELECT market_pk, count(*) AS n FROM trades GROUP BY market_pk) t ON t.market_pk = m.market_pk
)
SELECT market_pk, rank, CAST(least(100, round_even(100 * ln(1 + n) / ln(51), 0)) AS INT) AS evidence,
  CAST(least(100, round_even(100 * (1 - exp(-(CASE WHEN n > 0 THEN (8 + 0.4 * (rank + 1)) * ln(1 + n) ELSE 0 END) / 24)), 0)) AS INT) AS urgency FROM j""",
    "retention_tiers": f"WITH {TIERS_SQL} SELECT market_pk, score, tier, ttl_hours, sample_rate, array_to_string(reasons, ',') AS reasons FROM tiers",
    "prune_plan": f"""WITH {TIERS_SQL}
SELECT t.market_pk, trade_pk, tier, coalesce(close_us + (CASE tier WHEN 'observe_only' THEN 1 WHEN 'sampled' THEN 14 WHEN 'hot' THEN 30 WHEN 'triggered' THEN 90 WHEN 'case' THEN 365 END) * {DAY_US}
    <= {NOW_US + 20 * DAY_US}, false) AND NOT cnt > 90 AS pruned
FROM trades t LEFT JOIN tiers ON tiers.market_pk = t.market_pk""",
    "raw_expiry": f"""WITH {TIERS_SQL}
SELECT t.market_pk, count(*) AS rows_left, CAST(sum(cnt) AS DOUBLE) AS contracts_left FROM trades t LEFT JOIN tiers ON tiers.market_pk = t.market_pk
WHERE ttl_hours IS NULL OR ts_us + ttl_hours * 3600000000 > {ORIGIN_US + 86_400_000_000} GROUP BY t.market_pk""",
    "alert_rollup": f"""
SELECT user_id AS market_pk, epoch_us(ts) // {DAY_US} AS day,
  CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity, count(*) AS alerts, max(value) AS max_score,
  round(avg(value), 6) AS avg_score, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, arg_max(event_id, ts) AS latest_pk
FROM events GROUP BY ALL""",
    "metrics_merge": f"WITH {TRADES_SQL} SELECT market_pk, count(*) AS trade_count, max(ts_us) AS last_us, min(ts_us) AS first_us FROM trades GROUP BY market_pk",
    "latest_merge": f"""WITH {MARKETS_SQL}, {QUOTES_SQL},
l AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY market_pk ORDER BY ts_us DESC, quote_pk DESC) = 1)
SELECT coalesce(m.market_pk, l.market_pk) AS market_pk, CASE WHEN l.market_pk IS NULL THEN 0.5 ELSE l.yes_bid END AS yes_bid,
  coalesce(l.last_price, CASE WHEN m.market_pk IS NOT NULL THEN 0.25 END) AS last_price
FROM markets m FULL JOIN l ON l.market_pk = m.market_pk""",
    "article_keys": f"""WITH {ARTICLES_SQL} SELECT article_id, sha256(lower(trim(url))) AS url_hash, 'news.' || domain || '.example.com' AS host FROM articles""",
    "article_tokens": f"""WITH {ARTICLES_SQL},
r AS (SELECT article_id, [w FOR w IN list_distinct(regexp_extract_all(lower(title || ' ' || summary), '[a-z0-9]{{3,}}')) IF NOT list_contains({STOPWORDS!r}, w)] AS raw FROM articles),
o AS (SELECT article_id, raw, [{OTHER_SQL.format("w")} FOR w IN raw] AS once FROM r),
f AS (SELECT article_id, raw, [CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN {OTHER_SQL.format("left(w, length(w) - 1)")} ELSE w END FOR w IN once] AS forms FROM o),
t AS (SELECT article_id, list_distinct(list_concat(raw, [w FOR w IN forms IF length(w) > 2 AND NOT list_contains({STOPWORDS!r}, w)])) AS tokens FROM f)
SELECT article_id, CAST(len(tokens) AS INT) AS n_tokens, array_to_string(list_sort(tokens), ' ') AS tokens FROM t""",
}

# Later queries reuse the text of earlier ones as subqueries.
SQL |= {
    "market_alerts": f"""WITH {QUOTES_SQL}, {BOOK_SQL},
r AS (
  SELECT *, row_number() OVER w AS place, CASE WHEN last_price IS NOT NULL THEN 'last' ELSE 'mid' END AS mode,
    CASE WHEN last_price > 0 THEN last_price ELSE (yes_bid + yes_ask) / 2 END AS ref, yes_ask - yes_bid AS spread
  FROM quotes WINDOW w AS (PARTITION BY market_pk ORDER BY ts_us DESC, quote_pk DESC)
),
p AS (
  SELECT *, CASE WHEN place < 40 AND mode = lead(mode) OVER w THEN ref - lead(ref) OVER w END AS moved,
    CASE WHEN place < 40 THEN CAST(volume - lead(volume) OVER w AS DOUBLE) END AS traded
  FROM r WINDOW w AS (PARTITION BY market_pk ORDER BY place)
),
s AS (
  SELECT market_pk, list(spread ORDER BY place) FILTER (place <= 30) AS spreads, coalesce(list(moved ORDER BY place) FILTER (moved IS NOT NULL), []) AS moves,
    coalesce(list(traded ORDER BY place) FILTER (traded IS NOT NULL), []) AS volumes, arg_min(yes_bid, place) AS bid, arg_min(yes_ask, place) AS ask, arg_min(spread, place) AS spread,
    max(moved) FILTER (place = 1) AS moved, max(traded) FILTER (place = 1) AS traded, count(*) AS n
  FROM p WHERE place <= 40 GROUP BY market_pk
),
z AS (
  SELECT *, {", ".join(f"coalesce(len({c}) > 5 AND list_aggregate({c}[2:], 'stddev_samp') > 1e-9 AND abs({c}[1] - list_aggregate({c}[2:], 'avg')) / list_aggregate({c}[2:], 'stddev_samp') > 2.8, false) AS {c}_hit" for c in ("spreads", "moves", "volumes"))} FROM s
),
k AS (
  SELECT market_pk AS mk, count(*) > 400 AS churn, coalesce(-sum(delta) FILTER (NOT is_snapshot AND delta < 0), 0) > 75 AND count(*) FILTER (NOT is_snapshot) > 30 AS cancel
  FROM book WHERE received_us BETWEEN {ORIGIN_US + 2_500_000_000 - 180_000_000} AND {ORIGIN_US + 2_500_000_000} GROUP BY market_pk
),
rules AS (
  SELECT market_pk, [
    {{'t': spreads_hit, 'p': 2.5, 'r': 'wide spread vs recent baseline'}}, {{'t': NOT spreads_hit AND spread > 0.12, 'p': 2.0, 'r': 'wide spread'}},
    {{'t': bid = 0 AND ask = 0, 'p': 1.0, 'r': 'empty visible book'}}, {{'t': moves_hit, 'p': 3.0, 'r': 'large price move vs recent'}},
    {{'t': NOT moves_hit AND abs(moved) >= 0.15, 'p': 3.0, 'r': 'sharp price move'}}, {{'t': volumes_hit, 'p': 2.5, 'r': 'large volume change vs recent'}},
    {{'t': NOT volumes_hit AND traded >= 50, 'p': 2.5, 'r': 'large volume jump'}},
    {{'t': NOT volumes_hit AND traded >= 25 AND traded < 50, 'p': 1.0, 'r': 'moderate volume jump'}}, {{'t': n < 2, 'p': 0.0, 'r': 'limited history'}},
    {{'t': churn, 'p': 1.5, 'r': 'high order-book event rate'}}, {{'t': cancel, 'p': 2.0, 'r': 'sustained cancel side'}}] AS all_rules
  FROM z LEFT JOIN k ON mk = market_pk
),
hits AS (SELECT market_pk, [x FOR x IN all_rules IF coalesce(x.t, false)] AS h FROM rules)
SELECT market_pk, CAST(coalesce(list_sum([x.p FOR x IN h]), 0) AS DOUBLE) AS score,
  CASE WHEN coalesce(list_sum([x.p FOR x IN h]), 0) >= 5 THEN 'high' WHEN coalesce(list_sum([x.p FOR x IN h]), 0) >= 2.5 THEN 'medium'
       WHEN coalesce(list_sum([x.p FOR x IN h]), 0) > 0 THEN 'low' ELSE 'none' END AS severity,
  coalesce(array_to_string([x.r FOR x IN h], ','), '') AS reasons FROM hits""",
    "best_flags": f"""WITH scored AS ({SQL["tape_scores"]}), ranked AS (
  SELECT market_pk, trade_pk, score, row_number() OVER (PARTITION BY market_pk ORDER BY score DESC, trade_pk) AS rank FROM scored WHERE score >= 0.3
)
SELECT *, CASE WHEN score >= 8.5 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS severity FROM ranked WHERE rank <= 5""",
    "reason_codes": f"""WITH scored AS ({SQL["tape_scores"]}),
e AS (SELECT market_pk, trade_pk, unnest(string_split(reasons, ',')) AS code, generate_subscripts(string_split(reasons, ','), 1) AS place FROM scored WHERE score >= 0.3 AND reasons <> ''),
f AS (SELECT market_pk, code, min(trade_pk * 100 + place) AS pos FROM e GROUP BY market_pk, code)
SELECT market_pk, string_agg(code, ',' ORDER BY pos) AS codes FROM f GROUP BY market_pk""",
    "system_counters": f"""WITH scored AS ({SQL["tape_scores"]}), {TRADES_SQL}, {MARKETS_SQL}
SELECT (SELECT count(*) FROM markets) AS markets, (SELECT count(*) FROM markets WHERE status = 'active') AS active_markets,
  (SELECT count(*) FROM markets WHERE prior IN ('high', 'medium_high')) AS high_prior_markets, (SELECT count(*) FROM trades) AS prints,
  (SELECT CAST(coalesce(sum(cnt), 0) AS DOUBLE) FROM trades) AS contracts, (SELECT count(DISTINCT market_pk) FROM trades) AS traded_markets,
  (SELECT count(DISTINCT market_pk) FROM scored WHERE score >= 0.3) AS flagged_markets""",
    "baseline_lookup": f"""WITH b AS ({SQL["peer_baselines"]}), {MARKETS_SQL}
SELECT m.market_pk, CASE WHEN x.category IS NOT NULL THEN 'exact' WHEN y.category IS NOT NULL THEN 'category' END AS scope,
  CASE WHEN x.category IS NOT NULL THEN x.sample_size ELSE y.sample_size END AS sample_size,
  CASE WHEN x.category IS NOT NULL THEN x.count_p95 ELSE y.count_p95 END AS count_p95, CASE WHEN x.category IS NOT NULL THEN x.move_p95 ELSE y.move_p95 END AS move_p95
FROM markets m LEFT JOIN b x ON x.category = m.category AND x.subcategory = m.event_id LEFT JOIN b y ON y.category = m.category AND y.subcategory = '*'""",
}

SQL |= {
    "market_list": f"""WITH scored AS ({SQL["tape_scores"]}), m AS ({SQL["market_scores"]}), {TRADES_SQL}, {MARKETS_SQL},
t AS (SELECT market_pk, count(*) AS trade_count, max(ts_us) AS last_us FROM trades GROUP BY market_pk),
f AS (SELECT market_pk, max(score) AS top_flag, count(*) AS flags FROM scored WHERE score >= 0.3 GROUP BY market_pk)
SELECT market_pk, market_id, coalesce(trade_count, 0) AS trade_count, last_us, urgency, top_flag, coalesce(flags, 0) AS flags
FROM markets JOIN m USING (market_pk) LEFT JOIN t USING (market_pk) LEFT JOIN f USING (market_pk) ORDER BY urgency DESC, coalesce(trade_count, 0) DESC, market_pk LIMIT 100""",
    "event_groups": f"""WITH {MARKETS_SQL}
SELECT market_pk, event_id, close_us, CAST(row_number() OVER (PARTITION BY event_id ORDER BY close_us NULLS FIRST, market_pk) AS INT) AS place,
  count(*) OVER (PARTITION BY event_id) AS event_size FROM markets""",
    "link_prints": f"""WITH {TRADES_SQL}, {LINKS_SQL}
SELECT news_id, t.market_pk, trade_pk, CAST(row_number() OVER (PARTITION BY news_id ORDER BY ts_us, trade_pk) AS INT) AS place
FROM links n JOIN trades t ON t.market_pk = n.market_pk AND ts_us < news_us AND ts_us >= news_us - 86400000000 WHERE relevance >= 0.45 QUALIFY place <= 1000""",
    "known_prices": f"""WITH b AS ({SQL["price_bars"]}), q AS ({SQL["latest_quotes"]}), {TRADES_SQL}, {MARKETS_SQL},
qp AS (SELECT market_pk, greatest(0.0, least(1.0, coalesce(last_price, (yes_bid + yes_ask) / 2, yes_bid, yes_ask))) AS price FROM q),
bp AS (SELECT market_pk, arg_max(close_price, bucket) AS price FROM b GROUP BY market_pk),
tp AS (SELECT market_pk, arg_max(yes_price, ts_us) AS price FROM trades GROUP BY market_pk)
SELECT m.market_pk, coalesce(qp.price, bp.price, tp.price) AS price,
  CASE WHEN qp.price IS NOT NULL THEN 'quote' WHEN bp.price IS NOT NULL THEN 'bar' WHEN tp.price IS NOT NULL THEN 'trade' END AS source
FROM markets m LEFT JOIN qp ON qp.market_pk = m.market_pk LEFT JOIN bp ON bp.market_pk = m.market_pk LEFT JOIN tp ON tp.market_pk = m.market_pk""",
    "series_merge": f"""WITH a AS ({bars_sql(300)}), b AS ({bars_sql(900)}),
u AS (SELECT market_pk, bucket, close_price, 0 AS rank FROM a UNION ALL SELECT market_pk, bucket, close_price, 1 FROM b)
SELECT market_pk, bucket, arg_min(close_price, rank) AS close_price, min(rank) AS rank FROM u GROUP BY market_pk, bucket""",
    "quote_prune": f"""WITH b AS ({SQL["price_bars"]}), {QUOTES_SQL}
SELECT market_pk, quote_pk FROM quotes q WHERE ts_us < {ORIGIN_US + 1_800_000_000} AND NOT volume > 90
  AND EXISTS (SELECT 1 FROM b WHERE b.market_pk = q.market_pk AND b.bucket = q.ts_us // 300000000 * 300 AND trade_count > 2 AND quote_count > 0)
  AND quote_pk NOT IN (SELECT arg_max(quote_pk, ts_us) FROM quotes GROUP BY market_pk)""",
    "market_changes": f"""WITH {MARKETS_SQL}
SELECT CASE WHEN market_pk % 7 = 0 THEN 'inserted' WHEN market_pk % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS rows FROM markets GROUP BY 1""",
    "sampled_prints": f"""WITH {TIERS_SQL}
SELECT tier, count(*) AS prints, CAST(sum(cnt) AS DOUBLE) AS contracts FROM trades t LEFT JOIN tiers ON tiers.market_pk = t.market_pk
WHERE coalesce(sample_rate, 0.1) >= 1 OR (coalesce(sample_rate, 0.1) > 0
  AND CAST(CAST('0x' || substring(sha256(CAST(trade_pk AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < coalesce(sample_rate, 0.1)) GROUP BY tier""",
    "first_articles": f"""WITH {ARTICLES_SQL}
SELECT article_id, 'http://x/' || CAST(article_id % 50 AS VARCHAR) AS url, first_seen_us FROM articles
QUALIFY row_number() OVER (PARTITION BY article_id % 50 ORDER BY first_seen_us, article_id) = 1""",
}


def values_of(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


def diverse_step(strict: bool) -> str:
    """One step of the report's fold: r joins the chosen c, or not; both are lists."""
    alone = "len(list_filter(c, lambda x: x.market_pk = r[1].market_pk)) = 0 AND len(list_filter(c, lambda x: x.category IS NOT DISTINCT FROM r[1].category)) < 3"
    apart = alone if strict else "len(list_filter(c, lambda x: x.trade_pk = r[1].trade_pk)) = 0"
    free = "NOT r[1].sport OR (len(list_filter(c, lambda x: x.sport)) < 4 AND len(list_filter(c, lambda x: x.sport AND x.event = r[1].event)) = 0)"
    return f"CASE WHEN len(c) < 25 AND ({free}) AND {apart} THEN list_concat(c, r) ELSE c END"


SQL["diversified_flags"] = f"""WITH s AS ({SQL["tape_scores"]}), {TRADES_SQL}, {MARKETS_SQL},
top AS (
  SELECT s.market_pk, s.trade_pk, t.ts_us, s.score, m.category, m.event_id, coalesce(m.category IN ('machinery', 'building'), false) AS sport, coalesce('e' || m.event_id, 'm' || s.market_pk) AS event
  FROM s JOIN trades t ON t.trade_pk = s.trade_pk LEFT JOIN markets m ON m.market_pk = s.market_pk WHERE s.score >= 0.3 ORDER BY s.score DESC, t.ts_us DESC, s.trade_pk LIMIT 625),
whole AS (SELECT list([top] ORDER BY score DESC, ts_us DESC, trade_pk) AS rows FROM top),
once AS (SELECT rows, list_reduce(rows, lambda c, r: {diverse_step(True)}, rows[1][1:0]) AS chosen FROM whole),
twice AS (SELECT list_reduce(rows, lambda c, r: {diverse_step(False)}, chosen) AS chosen FROM once),
each AS (SELECT unnest(chosen) AS x, unnest(range(1, len(chosen) + 1)) AS place FROM twice)
SELECT x.market_pk, x.trade_pk, x.ts_us, x.score, x.category, x.event_id, place FROM each"""

SQL["market_labels"] = f"""WITH {MARKETS_SQL},
rules(i, needle, cat, sub, tags) AS (VALUES {values_of([(i, *r) for i, r in enumerate(TAG_RULES)])}),
cats(i, name, cat, sub) AS (VALUES {values_of([(i, k, *v) for i, (k, v) in enumerate(CATEGORIES.items())])}),
priors(pair, prior) AS (VALUES {values_of(list(PRIOR_OF.items()))}),
raw AS (
  SELECT market_pk, CASE WHEN market_pk % 4 > 0 THEN 'daily | ' || coalesce((SELECT needle FROM rules WHERE i = market_pk % 36), 'none') ELSE '' END AS hay, market_pk % 14 AS c FROM markets
),
hit AS (SELECT market_pk, min(i) AS i FROM raw JOIN rules ON contains(hay, needle) GROUP BY market_pk),
named AS (
  SELECT raw.market_pk, coalesce(r.cat, k.cat, 'other') AS category, coalesce(r.sub, k.sub, 'unclassified') AS subcategory,
    CASE WHEN r.i IS NOT NULL THEN 'tag:' || needle WHEN k.i IS NOT NULL THEN 'category:' || k.name ELSE 'all_layers_abstained' END AS rule,
    CASE WHEN r.i IS NOT NULL OR k.i IS NOT NULL THEN 'high' ELSE 'low' END AS confidence, coalesce(r.tags, '') AS tags
  FROM raw LEFT JOIN hit ON hit.market_pk = raw.market_pk LEFT JOIN rules r ON r.i = hit.i LEFT JOIN cats k ON k.i = raw.c
)
SELECT named.*, coalesce(p.prior, q.prior, 'medium') AS prior
FROM named LEFT JOIN priors p ON p.pair = category || '/' || subcategory LEFT JOIN priors q ON q.pair = category || '/*'"""
