"""Retention runs over several tables: evidence, roll-up, deletion and counters as one change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.operators import retention
from tapeglass.sources.versions import Versions

EVIDENCE_SCORE = 7.0
PLAIN = ("none", "low")


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], merged: Callable) -> DataFrame:
    """Both tables by key; where both have one, ``merged(old column, new column, name)``."""
    names = [c for c in new.columns if c not in keys]
    joined = old.select(*keys, F.struct(*names).alias("o")).join(new.select(*keys, F.struct(*names).alias("n")), keys, "full")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    return joined.select(*keys, *[F.when(both, merged(F.col("o"), F.col("n"), c)).otherwise(F.coalesce(F.col("n")[c], F.col("o")[c])).alias(c) for c in names])


def merged_rollup(old: DataFrame, new: DataFrame) -> DataFrame:
    """Daily summaries of :func:`retention.alert_rollup` added up; means by their counts."""

    def merged(o, n, c):
        rules = {
            "alerts": o["alerts"] + n["alerts"],
            "avg_score": F.round((o["avg_score"] * o["alerts"] + n["avg_score"] * n["alerts"]) / (o["alerts"] + n["alerts"]), 6),
            "max_score": F.greatest(o["max_score"], n["max_score"]),
            "first_us": F.least(o["first_us"], n["first_us"]),
            "last_us": F.greatest(o["last_us"], n["last_us"]),
            "latest_pk": F.when(n["last_us"] >= o["last_us"], n["latest_pk"]).otherwise(o["latest_pk"]),
        }
        return rules[c]

    return keyed_merge(old, new, ["market_pk", "day", "severity"], merged)


def merged_evidence(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence by source: the new row, but never a lower score than before."""
    return keyed_merge(old, new, keys, lambda o, n, c: F.greatest(o[c], n[c]) if c == "score" else n[c])


def alert_retention(versions: Versions, run_id: str, tiers: DataFrame, cutoff_us: int, severities: list[str], least_score: float = EVIDENCE_SCORE) -> bool:
    """Alerts of ``severities`` before ``cutoff_us`` go: those above low, or from ``least_score`` on, are
    copied to alert_evidence with their market's tier, all are added to alert_days, and the alert
    counts of markets fall, not below their high ones or 0. False if the run was applied before."""
    alerts, counts = versions.table("alerts"), versions.table("counts")
    old = (F.col("created_us") < cutoff_us) & F.col("severity").isin(*severities)
    gone = alerts.where(old)
    kept = alerts.where(~F.coalesce(old, F.lit(False)))
    proof = gone.where(~F.col("severity").isin(*PLAIN) | (F.col("score") >= least_score))
    proof = proof.join(tiers.select("market_pk", "tier"), "market_pk", "left").select("alert_pk", "market_pk", "created_us", "severity", "score", "tier")
    evidence = merged_evidence(versions.table("alert_evidence"), proof, ["alert_pk"]) if versions.has("alert_evidence") else proof
    days = retention.alert_rollup(gone)
    rolled = merged_rollup(versions.table("alert_days"), days) if versions.has("alert_days") else days
    fewer = gone.groupBy("market_pk").agg(F.count("*").alias("fewer"))
    left = F.greatest(F.coalesce("alerts", F.lit(0)) - F.coalesce("fewer", F.lit(0)), F.coalesce("high_alerts", F.lit(0)), F.lit(0))
    new_counts = counts.join(fewer, "market_pk", "left").select("market_pk", F.when(F.col("fewer").isNull(), F.col("alerts")).otherwise(left).cast("long").alias("alerts"), "high_alerts")
    return versions.commit(run_id, replace={"alerts": kept, "alert_evidence": evidence, "alert_days": rolled, "counts": new_counts})


def trade_retention(versions: Versions, run_id: str, tiers: DataFrame, now_us: int) -> bool:
    """Flags of prints in closed markets are copied to trade_evidence by (trade_pk, scorer_version), then
    prints go whose market closed longer ago than its tier allows and that no flag refers to. ``tiers``
    has (market_pk, tier, close_us). False if the run was applied before."""
    trades, flags = versions.table("trades"), versions.table("flags")
    closed = tiers.where(F.col("close_us") <= now_us).select("market_pk", "tier")
    proof = flags.join(trades.drop("market_pk"), "trade_pk").join(closed, "market_pk").select(
        "trade_pk", "scorer_version", "market_pk", "ts_us", "yes_price", "no_price", "count", "taker_side", "score", "severity", "tier"
    )
    evidence = merged_evidence(versions.table("trade_evidence"), proof, ["trade_pk", "scorer_version"]) if versions.has("trade_evidence") else proof
    plan = retention.prune_plan(trades, tiers, flags, now_us).where("pruned").select("trade_pk")
    return versions.commit(run_id, replace={"trades": trades.join(plan, "trade_pk", "left_anti"), "trade_evidence": evidence})
