"""Domain tables made from star-schema tables: trades, quotes, book events, markets, articles.

Times of the tape are compressed a thousandfold from ORIGIN_US on, so that short-horizon
operators see bursts. Every adapter is a projection: filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC
NOW_US = 1_704_412_800_000_000  # 2024-01-05 00:00:00 UTC, the reference "now" of batch jobs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compressed_us(ts: Column) -> Column:
    return F.lit(ORIGIN_US) + F.floor((F.unix_micros(ts.cast("timestamp")) - F.lit(ORIGIN_US)) / F.lit(1000)).cast("long")


def price_slot() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market_pk, trade_pk, ts_us, count, yes_price, no_price, taker_side), one print per event."""
    side = F.when(F.col("event_type").isin("click", "purchase"), "yes").when(F.col("event_type").isin("view", "error"), "no")
    yes = (price_slot() + F.lit(0.5)) / 100
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("market_pk"),
        F.col("event_id").alias("trade_pk"),
        compressed_us(F.col("ts")).alias("ts_us"),
        F.col("value").cast("decimal(18,2)").alias("count"),
        yes.alias("yes_price"),
        (1 - yes).alias("no_price"),
        side.alias("taker_side"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market_pk, quote_pk, ts_us, yes_bid, yes_ask, last_price, volume): one quote per event."""
    k = price_slot()
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("market_pk"),
        F.col("event_id").alias("quote_pk"),
        compressed_us(F.col("ts")).alias("ts_us"),
        (k / 100).alias("yes_bid"),
        F.least(F.lit(1.0), (k + 1 + F.col("event_id") % 15) / 100).alias("yes_ask"),
        F.when(F.col("event_id") % 3 == 0, (k + 0.5) / 100).alias("last_price"),
        F.col("value").cast("decimal(18,2)").alias("volume"),
    )


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market_pk, seq, received_us, delta, is_snapshot): signed size changes."""
    size = F.col("value").cast("decimal(18,2)")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("market_pk"),
        F.col("event_id").alias("seq"),
        compressed_us(F.col("ts")).alias("received_us"),
        F.when(F.col("event_type").isin("click", "purchase"), size).otherwise(-size).cast("decimal(18,2)").alias("delta"),
        (F.col("event_type") == "signup").alias("is_snapshot"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market_pk, market_id, event_id, category, prior, status, close_us) from customers and nations."""
    bal = F.col("c_acctbal")
    prior = F.when(bal < 0, "very_low").when(bal < 2500, "low").when(bal < 5000, "medium").when(bal < 7500, "medium_high").otherwise("high")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        read(spark, sf_dir, "customer")
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # at most one row per country
        .select(
            F.col("c_custkey").alias("market_pk"),
            F.col("c_name").alias("market_id"),
            F.col("n_name").alias("event_id"),
            F.lower("c_mktsegment").alias("category"),
            prior.alias("prior"),
            F.when(bal >= 0, "active").otherwise("closed").alias("status"),
            (F.lit(ORIGIN_US + 43_200_000_000) + (F.col("c_custkey") % 30) * F.lit(86_400_000_000)).alias("close_us"),
        )
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, url, domain, title, summary, first_seen_us) from documents: the first line and the rest."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.lit("HTTPS://News."), F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("domain"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)").alias("summary"),
        (F.lit(ORIGIN_US - 86_400_000_000) + (F.col("doc_id") * 7 % 5760) * F.lit(60_000_000)).alias("first_seen_us"),
    )


# The same tables as SQL common table expressions.
TRADES_SQL = f"""trades AS (
  SELECT user_id AS market_pk, event_id AS trade_pk, {ORIGIN_US} + (epoch_us(ts) - {ORIGIN_US}) // 1000 AS ts_us,
         CAST(value AS DECIMAL(18,2)) AS cnt, (CAST(json_extract(props, '$.k') AS INTEGER) + CAST(0.5 AS DOUBLE)) / 100 AS yes_price,
         1 - (CAST(json_extract(props, '$.k') AS INTEGER) + CAST(0.5 AS DOUBLE)) / 100 AS no_price,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'yes' WHEN event_type IN ('view', 'error') THEN 'no' END AS taker_side
  FROM events)"""
QUOTES_SQL = f"""quotes AS (
  SELECT user_id AS market_pk, event_id AS quote_pk, {ORIGIN_US} + (epoch_us(ts) - {ORIGIN_US}) // 1000 AS ts_us,
         CAST(json_extract(props, '$.k') AS INTEGER) / CAST(100 AS DOUBLE) AS yes_bid,
         least(1.0, (CAST(json_extract(props, '$.k') AS INTEGER) + 1 + event_id % 15) / CAST(100 AS DOUBLE)) AS yes_ask,
         CASE WHEN event_id % 3 = 0 THEN (CAST(json_extract(props, '$.k') AS INTEGER) + CAST(0.5 AS DOUBLE)) / 100 END AS last_price,
         CAST(value AS DECIMAL(18,2)) AS volume
  FROM events)"""
BOOK_SQL = f"""book AS (
  SELECT user_id AS market_pk, event_id AS seq, {ORIGIN_US} + (epoch_us(ts) - {ORIGIN_US}) // 1000 AS received_us,
         CASE WHEN event_type IN ('click', 'purchase') THEN CAST(value AS DECIMAL(18,2)) ELSE -CAST(value AS DECIMAL(18,2)) END AS delta,
         event_type = 'signup' AS is_snapshot
  FROM events)"""
MARKETS_SQL = f"""markets AS (
  SELECT c_custkey AS market_pk, c_name AS market_id, n_name AS event_id, lower(c_mktsegment) AS category,
         CASE WHEN c_acctbal < 0 THEN 'very_low' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 5000 THEN 'medium'
              WHEN c_acctbal < 7500 THEN 'medium_high' ELSE 'high' END AS prior,
         CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'closed' END AS status,
         {ORIGIN_US + 43_200_000_000} + (c_custkey % 30) * 86400000000 AS close_us
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
ARTICLES_SQL = f"""articles AS (
  SELECT doc_id AS article_id, 'HTTPS://News.' || source || '.example.com/a/' || CAST(doc_id AS VARCHAR) AS url, source AS domain,
         split_part(text, chr(10), 1) AS title, substring(text, length(split_part(text, chr(10), 1)) + 2) AS summary,
         {ORIGIN_US - 86_400_000_000} + (doc_id * 7 % 5760) * 60000000 AS first_seen_us
  FROM documents)"""
