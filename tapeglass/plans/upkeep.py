"""Queries of retention runs, stored bars and the raw-tape gate over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.functions import scores
from tapeglass.operators import folds, upkeep
from tapeglass.plans.queries import alerts, tiers
from tapeglass.plans.sql import TIERS_SQL
from tapeglass.sources import adapters as src
from tapeglass.sources.storage import shared_folder
from tapeglass.sources.versions import Versions
from tapeglass.streaming import gates, late

DAY_US = 86_400_000_000
RUNS = [("low alerts", src.ORIGIN_US + 10 * DAY_US, ["low"]), ("older alerts", src.ORIGIN_US + 20 * DAY_US, ["low", "medium"])]
BAR_US = 300_000_000
SCORER = 1


def versions(spark: SparkSession, name: str) -> Versions:
    return Versions(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}")


def alert_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Two retention runs over all alerts, the first repeated: what is left, kept as evidence, rolled up
    and counted of each market."""
    every = alerts(spark, d)
    counts = every.groupBy("market_pk").agg(F.count("*").alias("alerts"), F.count_if(F.col("severity").isin("high", "critical")).alias("high_alerts"))
    stored, known = versions(spark, "alerts"), tiers(spark, d)
    stored.commit("start", replace={"alerts": every, "counts": counts})
    for name, cutoff, severities in [RUNS[0], *RUNS]:
        upkeep.alert_retention(stored, name, known, cutoff, severities)
    left = stored.table("alerts").groupBy("market_pk").agg(F.count("*").alias("left"))
    proof = stored.table("alert_evidence").groupBy("market_pk").agg(F.count("*").alias("evidence"), F.max("score").alias("best"), F.max("tier").alias("tier"))
    days = stored.table("alert_days").groupBy("market_pk").agg(F.count("*").alias("days"), F.sum("alerts").alias("rolled"), F.max("max_score").alias("max_score"))
    joined = stored.table("counts").join(left, "market_pk", "left").join(proof, "market_pk", "left").join(days, "market_pk", "left")
    return joined.select("market_pk", F.col("alerts").alias("counted"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("evidence", F.lit(0)).alias("evidence"), "best", "tier", "days", "rolled", "max_score")


def trade_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """A retention run over all prints, large ones being flagged: prints left and evidence of each market."""
    prints = src.trades(spark, d).withColumn("count", F.col("count").cast("double"))
    flags = prints.where("count > 90").select("market_pk", "trade_pk", F.lit(SCORER).alias("scorer_version"), F.col("count").alias("score"), F.lit("high").alias("severity"))
    stored = versions(spark, "trades")
    stored.commit("start", replace={"trades": prints, "flags": flags})
    upkeep.trade_retention(stored, "closed", tiers(spark, d), src.NOW_US + 20 * DAY_US)
    left = stored.table("trades").groupBy("market_pk").agg(F.count("*").alias("left"))
    proof = stored.table("trade_evidence").groupBy("market_pk").agg(F.count("*").alias("evidence"), F.max("score").alias("best"))
    return left.join(proof, "market_pk", "full").select("market_pk", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("evidence", F.lit(0)).alias("evidence"), "best")


def replayed_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of prints that came in four batches by number, every twentieth by hash one batch late, after
    the late ones were replayed."""
    prints = src.trades(spark, d)
    size = F.greatest(F.lit(1), F.ceil((F.max("trade_pk") + 1) / 4))
    most = prints.agg(size.alias("size")).first()["size"] or 1
    delay = F.when(F.conv(F.substring(F.md5(F.col("trade_pk").cast("string")), 1, 4), 16, 10).cast("int") % 20 == 0, 1).otherwise(0)
    rows = prints.select(F.col("market_pk").cast("string").alias("market_id"), "ts_us", "yes_price", F.col("count").cast("double").alias("count"), (F.floor(F.col("trade_pk") / most) + delay).alias("batch"))
    stored = versions(spark, "bars")
    write = late.bar_sink(stored, "bars", BAR_US, BAR_US)
    for n in range(5):
        write(rows.where(F.col("batch") == n), n)
    late.replay_late(stored, "replay", BAR_US)
    bars = late.merged_bars(stored.table("bar_parts"))
    return bars.select("market_id", "bucket", "high_price", "low_price", "trade_count", F.round("trade_volume", 6).alias("trade_volume"))


def tape_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every print by the hints known at its time, which a critical alert upgrades: prints decided and
    stored by market and tier."""
    base = src.markets(spark, d).select("market_pk", F.lit(0).cast("long").alias("ts"), "prior", F.lit(False).alias("has_alert"))
    told = src.trades(spark, d).where("count >= 40").select("market_pk", F.col("ts_us").alias("ts"), F.lit(True).alias("has_alert")).join(base.select("market_pk", "prior"), "market_pk")
    hints = base.unionByName(told.select(*base.columns)).select("market_pk", "ts", "prior", F.lit(False).alias("closing"), F.lit(0.0).alias("volume_24h"), F.lit(0.0).alias("open_interest"), "has_alert", F.lit(False).alias("has_flag"))
    rows = src.trades(spark, d).select("market_pk", F.col("ts_us").alias("ts"), "trade_pk")
    decided = gates.decide(gates.with_hints(rows, hints, "market_pk"))
    key = F.concat(F.lit("trade:"), F.col("market_pk").cast("string"), F.lit(":"), F.col("trade_pk").cast("string"))
    kept = gates.stored_tape(decided, key).groupBy("market_pk", "tier").agg(F.count("*").alias("stored"))
    snapped = gates.stored_snapshots(decided, key).groupBy("market_pk", "tier").agg(F.count("*").alias("snapshots"))
    sums = decided.groupBy("market_pk", "tier").agg(F.count("*").alias("prints"), F.min(gates.run_interval_ms(F.col("tier"))).alias("run_ms"))
    joined = sums.join(kept, ["market_pk", "tier"], "left").join(snapped, ["market_pk", "tier"], "left")
    return joined.select("market_pk", "tier", "prints", "run_ms", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


def alert_runs(spark: SparkSession, d: str) -> DataFrame:
    """The quotes after which a market's alerts are evaluated: by the interval of the tier that its
    prior gives, on the compressed tape (a thousandth)."""
    prior = scores.retention_reasons(F.col("prior"), F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(False))
    known = src.markets(spark, d).select("market_pk", scores.storage_tier(scores.retention_score(prior)).alias("tier"))
    rows = src.quotes(spark, d).select("market_pk", "quote_pk", "ts_us").join(known, "market_pk", "left").withColumn("gap_us", gates.run_interval_ms(F.col("tier")).cast("long"))
    return folds.throttle(rows, ["market_pk"], ["ts_us", "quote_pk"], "gap_us").select("market_pk", "quote_pk", "ts_us", "tier")


QUERIES = {f.__name__: f for f in (alert_upkeep, trade_upkeep, replayed_bars, tape_gate, alert_runs)}

(_, CUT_1, _), (_, CUT_2, _) = RUNS
def fold_sql(rows: str, first: dict[str, str], then: dict[str, str]) -> str:
    """f: rows (x, numbered by rn in each market) with the state columns after each: ``first`` from the
    row alone, ``then`` from the row and the state of the one before (f)."""
    start, step = (", ".join(f"{v} AS {k}" for k, v in c.items()) for c in (first, then))
    return f"x AS ({rows}), f AS (SELECT x.*, {start} FROM x WHERE rn = 1 UNION ALL SELECT x.*, {step} FROM f JOIN x ON x.market_pk = f.market_pk AND x.rn = f.rn + 1)"


def near_sql(c: str, tolerance: float) -> str:
    return f"(x.{c} IS NULL AND f.last_{c} IS NULL OR coalesce(abs(x.{c} - f.last_{c}) <= {tolerance} + 1e-12, false))"


NUMBERED = "row_number() OVER (PARTITION BY q.market_pk ORDER BY ts_us, quote_pk) AS rn"
DUE = "x.ts_us - f.last_us >= {0}"
HELD = f"NOT (x.ts_us - f.last_us < 120000000 AND {near_sql('yes_bid', 1e-4)} AND {near_sql('volume', 1e-2)})"
EPISODE = f"f.created IS NULL OR x.rank > f.rank_now OR x.created_us - f.created >= {48 * 3_600_000_000}"
PRICED = f"{DUE.format(60_000_000)} OR x.priced"
ALERT_ROWS = """SELECT user_id AS market_pk, event_id AS alert_pk, epoch_us(ts) AS created_us, value AS score, CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN value >= 40 THEN 4 WHEN value >= 20 THEN 3 WHEN value >= 10 THEN 2 ELSE 1 END AS rank, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events"""
TIER_ROWS = f"""SELECT q.market_pk, quote_pk, ts_us, tier, CASE tier WHEN 'observe_only' THEN 3600000 ELSE 1800000 END AS gap, {NUMBERED}
  FROM quotes q LEFT JOIN (SELECT market_pk, CASE WHEN prior IN ('high', 'medium_high') THEN 'sampled' ELSE 'observe_only' END AS tier FROM markets) t ON t.market_pk = q.market_pk"""
THROTTLED = fold_sql(
    f"SELECT market_pk, quote_pk, ts_us, last_price IS NOT NULL AS priced, {NUMBERED} FROM quotes q",
    {"last_us": "ts_us", "kept": "true"},
    {"last_us": f"CASE WHEN {PRICED} THEN x.ts_us ELSE f.last_us END", "kept": PRICED},
)
SUPPRESSED = fold_sql(
    f"SELECT market_pk, quote_pk, ts_us, round(yes_bid, 1) AS yes_bid, round(CAST(volume AS DOUBLE), -2) AS volume, {NUMBERED} FROM quotes q",
    {"last_us": "ts_us", "last_yes_bid": "yes_bid", "last_volume": "volume", "kept": "true"},
    {f"last_{c}": f"CASE WHEN {HELD} THEN x.{'ts_us' if c == 'us' else c} ELSE f.last_{c} END" for c in ("us", "yes_bid", "volume")} | {"kept": HELD},
)
EPISODES = fold_sql(
    ALERT_ROWS,
    {"created": "CASE WHEN score >= 3 THEN created_us END", "rank_now": "CASE WHEN score >= 3 THEN rank ELSE -1 END", "action": "CASE WHEN score >= 3 THEN 'created' END"},
    {
        "created": f"CASE WHEN x.score >= 3 AND ({EPISODE}) THEN x.created_us ELSE f.created END",
        "rank_now": "CASE WHEN x.score >= 3 THEN x.rank ELSE f.rank_now END",
        "action": f"CASE WHEN x.score < 3 THEN NULL WHEN {EPISODE} THEN 'created' ELSE 'updated' END",
    },
)
RUNS_BY_TIER = fold_sql(TIER_ROWS, {"last_us": "ts_us", "kept": "true"}, {"last_us": f"CASE WHEN {DUE.format('x.gap')} THEN x.ts_us ELSE f.last_us END", "kept": DUE.format("x.gap")})
UPKEEP_SQL: dict[str, str] = {
    "quote_throttle": f"WITH RECURSIVE {src.QUOTES_SQL}, {THROTTLED} SELECT market_pk, quote_pk, ts_us, priced FROM f WHERE kept",
    "quote_suppression": f"WITH RECURSIVE {src.QUOTES_SQL}, {SUPPRESSED} SELECT market_pk, quote_pk, ts_us, yes_bid, volume FROM f WHERE kept",
    "alert_episodes": f"WITH RECURSIVE {EPISODES} SELECT market_pk, alert_pk, created_us, severity, score, action FROM f WHERE action IS NOT NULL",
    "alert_runs": f"WITH RECURSIVE {src.MARKETS_SQL}, {src.QUOTES_SQL}, {RUNS_BY_TIER} SELECT market_pk, quote_pk, ts_us, tier FROM f WHERE kept",
    "alert_upkeep": f"""WITH {TIERS_SQL},
al AS (SELECT user_id AS market_pk, epoch_us(ts) AS us, value AS score, CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS sev FROM events),
st AS (SELECT *, CASE WHEN sev = 'low' AND us < {CUT_1} THEN 1 WHEN sev IN ('low', 'medium') AND us < {CUT_2} THEN 2 ELSE 0 END AS run FROM al),
su AS (
  SELECT market_pk, count(*) AS n, count(*) FILTER (sev IN ('high', 'critical')) AS high, count(*) FILTER (run = 1) AS one, count(*) FILTER (run = 2) AS two, count(*) FILTER (run = 0) AS kept,
    count(*) FILTER (run > 0 AND (sev = 'medium' OR score >= {upkeep.EVIDENCE_SCORE})) AS evidence, max(score) FILTER (run > 0 AND (sev = 'medium' OR score >= {upkeep.EVIDENCE_SCORE})) AS best, max(score) FILTER (run > 0) AS max_score
  FROM st GROUP BY market_pk),
da AS (SELECT market_pk, count(*) AS days FROM (SELECT DISTINCT market_pk, us // {DAY_US}, sev FROM st WHERE run > 0) GROUP BY market_pk),
c1 AS (SELECT *, CASE WHEN one > 0 THEN greatest(n - one, high, 0) ELSE n END AS after FROM su)
SELECT c.market_pk, CASE WHEN two > 0 THEN greatest(after - two, high, 0) ELSE after END AS counted, kept AS left, evidence, best, CASE WHEN evidence > 0 THEN t.tier END AS tier, days, nullif(one + two, 0) AS rolled, max_score
FROM c1 c LEFT JOIN da USING (market_pk) LEFT JOIN tiers t ON t.market_pk = c.market_pk""",
    "trade_upkeep": f"""WITH {TIERS_SQL},
p AS (SELECT t.market_pk, cnt, close_us <= {src.NOW_US + 20 * DAY_US} AS closed,
    cnt <= 90 AND coalesce(close_us + CASE tier WHEN 'observe_only' THEN 1 WHEN 'sampled' THEN 14 WHEN 'hot' THEN 30 WHEN 'triggered' THEN 90 ELSE 365 END * {DAY_US} <= {src.NOW_US + 20 * DAY_US}, false) AS pruned
  FROM trades t LEFT JOIN tiers r ON r.market_pk = t.market_pk)
SELECT market_pk, count(*) FILTER (NOT pruned) AS left, count(*) FILTER (closed AND cnt > 90) AS evidence, CAST(max(cnt) FILTER (closed AND cnt > 90) AS DOUBLE) AS best FROM p GROUP BY market_pk
HAVING count(*) FILTER (NOT pruned) > 0 OR count(*) FILTER (closed AND cnt > 90) > 0""",
    "replayed_bars": f"""WITH {src.TRADES_SQL}
SELECT CAST(market_pk AS VARCHAR) AS market_id, ts_us // {BAR_US} * {BAR_US} AS bucket, max(yes_price) AS high_price, min(yes_price) AS low_price, count(*) AS trade_count, round(CAST(sum(cnt) AS DOUBLE), 6) AS trade_volume
FROM trades GROUP BY ALL""",
    "tape_gate": f"""WITH {src.TRADES_SQL}, {src.MARKETS_SQL},
fa AS (SELECT t.market_pk, min(ts_us) AS first_us FROM trades t JOIN markets m ON m.market_pk = t.market_pk WHERE cnt >= 40 GROUP BY t.market_pk),
de AS (
  SELECT t.market_pk, trade_pk, CASE WHEN prior IN ('high', 'medium_high') THEN 30 WHEN prior = 'medium' THEN 10 ELSE 0 END AS base, coalesce(first_us <= ts_us, false) AS alert
  FROM trades t LEFT JOIN markets m ON m.market_pk = t.market_pk LEFT JOIN fa ON fa.market_pk = t.market_pk),
sc AS (SELECT *, CASE WHEN base < 20 AND alert THEN base + 35 ELSE base END AS score, ('0x' || substr(sha256('trade:' || market_pk || ':' || trade_pk), 1, 13))::BIGINT / CAST(16 ** 13 AS DOUBLE) AS share FROM de),
ti AS (SELECT *, CASE WHEN score >= 50 THEN 'hot' WHEN score >= 20 THEN 'sampled' ELSE 'observe_only' END AS tier, score >= 50 OR score >= 20 AND share < 0.1 AS stored FROM sc)
SELECT market_pk, tier, count(*) AS prints, CAST(CASE tier WHEN 'hot' THEN 0 WHEN 'sampled' THEN 1800000 ELSE 3600000 END AS INT) AS run_ms, count(*) FILTER (stored) AS stored, count(*) FILTER (stored) AS snapshots FROM ti GROUP BY market_pk, tier""",
}
