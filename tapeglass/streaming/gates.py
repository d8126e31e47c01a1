"""What of a stream is stored: the raw tape by tier, quote snapshots, alert runs; the same columns for
batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions import scores

HINTS = ["prior", "closing", "volume_24h", "open_interest", "has_alert", "has_flag"]
FULL_TIERS = ("hot", "triggered", "case")
# Milliseconds between alert runs of a market, by tier; full tiers always run.
ALERT_RUN_MS = {"sampled": 1_800_000, "observe_only": 3_600_000}
DEFAULT_RUN_MS = 1_800_000
FLAG_BURST = 3.0  # the burst score that a stored high flag stands for


def with_hints(rows: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """``rows`` with the HINTS of the newest version at or before each row's ts; both static."""
    left = [c for c in rows.columns if c not in (key, "ts")]
    one = rows.select(key, "ts", F.lit(1).alias("kind"), *left, F.lit(None).cast(f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in versions.select(*HINTS).schema)}>").alias("hint"))
    two = versions.select(key, "ts", F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in left], F.struct(*HINTS).alias("hint"))
    order = Window.partitionBy(key).orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = one.unionByName(two).withColumn("newest", F.last("hint", ignorenulls=True).over(order)).where("kind = 1")
    return found.select(*rows.columns, "newest.*")


def decide(rows: DataFrame) -> DataFrame:
    """``rows`` (with HINTS) and the score, tier and sample_rate of each.

    The score comes from the hints alone; where that stores nothing, a stored alert raises it, and
    without one a stored high flag, as a burst."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))

    def score(alert: Column, burst: Column) -> Column:
        reasons = scores.retention_reasons(F.col("prior"), flag("closing"), F.col("volume_24h"), F.col("open_interest"), alert, {"burst_score": burst})
        return scores.retention_score(reasons)

    nothing = F.lit(None).cast("double")
    plain = score(F.lit(False), nothing)
    raised = F.when(flag("has_alert"), score(F.lit(True), nothing)).when(flag("has_flag"), score(F.lit(False), F.lit(FLAG_BURST))).otherwise(plain)
    chosen = rows.withColumn("plain_score", plain).withColumn("score", F.when(scores.sample_rate(F.col("plain_score")) > 0, F.col("plain_score")).otherwise(raised))
    return chosen.drop("plain_score").select("*", scores.storage_tier(F.col("score")).alias("tier"), scores.sample_rate(F.col("score")).alias("sample_rate"))


def stored_tape(decided: DataFrame, row_key: Column) -> DataFrame:
    """Rows of the raw tape that are stored: by key, at the tier's rate."""
    return decided.where(scores.keyed_sample(row_key, F.col("sample_rate")))


def stored_snapshots(decided: DataFrame, row_key: Column) -> DataFrame:
    """Quote snapshots that are stored: all of the full tiers, others by key."""
    return decided.where(F.col("tier").isin(*FULL_TIERS) | scores.keyed_sample(row_key, F.col("sample_rate")))


def run_interval_ms(tier: Column) -> Column:
    """Milliseconds from one alert run of a market to the next; 0 for the tiers that always run."""
    out = F.when(tier.isin(*FULL_TIERS), 0)
    for name, ms in ALERT_RUN_MS.items():
        out = out.when(tier == name, ms)
    return out.otherwise(DEFAULT_RUN_MS)
