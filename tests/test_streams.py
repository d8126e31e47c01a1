"""Streams against their batch forms: rows dealt to micro-batches in any order give the same result."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeglass.operators import folds
from tapeglass.streaming import gates, jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = START + timedelta(days=3)


def streamed(spark, tmp_path, name, frames, make, late_rows=None):
    """Rows of ``make(stream)`` where the stream gets ``frames`` one micro-batch each."""
    folder = str(tmp_path / name)
    frames[0].limit(0).write.parquet(folder)
    source = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    try:
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def dealt(spark, rows, schema, end_row, seed=0, parts=3, near=timedelta(hours=1)):
    """Rows in micro-batches, each row up to ``near`` out of order, and a last row that ends the wait."""
    rng = random.Random(seed)
    at = [f.strip().split()[0] for f in schema.split(",")].index("ts")
    moved = sorted(rows, key=lambda r: r[at] + near * rng.random())
    size = -(-len(moved) // parts)
    return [spark.createDataFrame(moved[i : i + size], schema) for i in range(0, len(moved), size)] + [spark.createDataFrame([end_row], schema)]


def test_throttle_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"m{i % 3}", START + timedelta(seconds=rng.randrange(20_000)), i) for i in range(150)]
    schema = "market_id string, ts timestamp, quote_pk long"
    frames = dealt(spark, rows, schema, ("end", END, -1))
    got = streamed(spark, tmp_path, "throttled", frames, lambda s: jobs.live_throttle(s, "market_id", 600_000, late="2 hours", ties=("quote_pk",)))
    batch = spark.createDataFrame(rows, schema).withColumn("ts_us", F.unix_micros("ts"))
    want = folds.throttle(batch, ["market_id"], ["ts_us", "quote_pk"], 600_000_000).collect()
    assert {r.quote_pk for r in got} == {r.quote_pk for r in want} and len(got) == len(want) < 150


def test_an_earlier_row_in_a_later_batch(spark, tmp_path):
    schema = "market_id string, ts timestamp, quote_pk long"
    frames = [spark.createDataFrame([r], schema) for r in (("m", START + timedelta(minutes=100), 1), ("m", START + timedelta(minutes=20), 2), ("end", END, -1))]
    got = streamed(spark, tmp_path, "earlier", frames, lambda s: jobs.live_throttle(s, "market_id", 3_600_000, late="3 hours"))
    assert {r.quote_pk for r in got} == {1, 2}


def test_suppression_and_episodes_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        at = rng.randrange(12_000)
        rows.append((i % 2, at // 700, i, START + timedelta(seconds=at), rng.choice([0.1, 0.2, None]), 5.0, rng.choice(["low", "high", None, "medium"]), rng.choice([1.0, 4.0, 8.0, None])))
    schema = "market_pk long, quote_pk long, alert_pk long, ts timestamp, price double, size double, severity string, score double"
    frame = spark.createDataFrame(rows, schema).withColumn("ts_us", F.unix_micros("ts")).withColumn("created_us", F.unix_micros("ts"))
    unique = frame.withColumn("quote_pk", F.col("alert_pk"))
    want_kept = {r.alert_pk for r in folds.suppress_unchanged(unique, ["price"], ["size"]).collect()}
    want_told = {(r.alert_pk, r.action) for r in folds.alert_episodes(frame).collect()}
    end = (9, -1, -1, END, None, None, None, None)
    frames = dealt(spark, rows, schema, end)
    told = streamed(spark, tmp_path, "told", frames, lambda s: jobs.live_episodes(s, "market_pk", late="2 hours"))
    assert {(r.alert_pk, r.action) for r in told} == want_told and "deleted" in {a for _, a in want_told}
    kept = streamed(spark, tmp_path, "kept", [f.withColumn("quote_pk", F.col("alert_pk")) for f in frames], lambda s: jobs.live_suppress(s, "market_pk", "price", "size", late="2 hours"))
    assert {r.alert_pk for r in kept} == want_kept


HINT = "market_pk long, ts timestamp, prior string, closing boolean, volume_24h double, open_interest double, has_alert boolean, has_flag boolean"


def test_gate_with_upgrades_equals_batch(spark, tmp_path):
    """Prints and versions of hints in three micro-batches, with upgrades between."""
    rng = random.Random(4)
    prints = [(i % 4, START + timedelta(seconds=rng.randrange(30_000)), i) for i in range(200)]
    hints = [(m, START - timedelta(hours=1), "low", False, 10.0, 0.0, False, False) for m in range(3)]
    hints += [(0, START + timedelta(hours=2), "high", False, 300.0, 250.0, False, False), (1, START + timedelta(hours=3), "low", False, 10.0, 0.0, True, False), (2, START + timedelta(hours=4), "low", False, 10.0, 0.0, False, True)]
    key = F.concat(F.lit("trade:"), F.col("market_pk").cast("string"), F.lit(":"), F.col("trade_pk").cast("string"))
    batch = gates.decide(gates.with_hints(spark.createDataFrame(prints, "market_pk long, ts timestamp, trade_pk long"), spark.createDataFrame(hints, HINT), "market_pk"))
    want = {(r.trade_pk, r.tier, r.score) for r in batch.collect()}
    assert {t for _, t, _ in want} == {"observe_only", "hot", "sampled"}
    schema = "kind int, trade_pk long, " + HINT
    rows = [(1, t, m, at, None, None, None, None, None, None) for m, at, t in prints] + [(0, None, *h) for h in hints]
    frames = dealt(spark, rows, schema, (1, -1, 99, END, None, None, None, None, None, None))

    def make(source):
        told = jobs.live_asof(source.where("kind = 1").select("market_pk", "ts", "trade_pk"), source.where("kind = 0").select("market_pk", "ts", *gates.HINTS), "market_pk", gates.HINTS, late="2 hours")
        return gates.decide(told)

    got = streamed(spark, tmp_path, "gated", frames, make)
    assert {(r.trade_pk, r.tier, r.score) for r in got} == want and len(got) == 200
    stored = gates.stored_tape(batch, key).collect()
    assert 0 < len(stored) < 200 and {r.tier for r in stored} <= {"hot", "sampled"}
    assert all(r.sample_rate == 1 or r.tier == "sampled" for r in stored)


@pytest.mark.parametrize("tier,ms", [("hot", 0), ("case", 0), ("sampled", 1_800_000), ("observe_only", 3_600_000), ("ignored", 1_800_000), (None, 1_800_000)])
def test_run_intervals(spark, tier, ms):
    assert spark.createDataFrame([(tier,)], "t string").select(gates.run_interval_ms(F.col("t"))).first()[0] == ms


def test_snapshots_of_full_tiers_are_all_stored(spark):
    rows = [(i, t, r) for i in range(50) for t, r in (("hot", 1.0), ("observe_only", 0.0), ("sampled", 0.1))]
    df = spark.createDataFrame(rows, "i long, tier string, sample_rate double")
    got = gates.stored_snapshots(df, F.concat_ws(":", "tier", "i")).groupBy("tier").count().collect()
    found = {r.tier: r["count"] for r in got}
    assert found["hot"] == 50 and "observe_only" not in found and found.get("sampled", 0) < 25


def test_book_activity_by_windows(spark):
    rows = [("m", START + timedelta(seconds=5 * i), -3.0 if i % 2 else 1.0, False) for i in range(80)] + [("m", START, 9.0, True)]
    got = jobs.live_book_activity(spark.createDataFrame(rows, "market_id string, ts timestamp, delta double, is_snapshot boolean")).collect()
    for r in got:
        end = r.at.replace(tzinfo=timezone.utc)
        inside = [x for x in rows if end - timedelta(minutes=3) <= x[1] < end]
        deltas = [x[2] for x in inside if not x[3]]
        pulled = -sum(x for x in deltas if x < 0)
        assert (r.book_events, r.book_deltas, r.pull_volume, r.heavy_cancel) == (len(inside), len(deltas), pulled, pulled > 75 and len(deltas) > 30)
    assert len(got) >= 8
