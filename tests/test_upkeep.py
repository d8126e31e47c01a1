"""Versions, run log, retention runs, late rows and counters."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeglass.operators import reads, retention, upkeep
from tapeglass.sources.versions import RunLog, Versions
from tapeglass.streaming import late

DAY = retention.DAY_US


def test_a_failed_run_changes_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    assert v.manifest()["version"] == 0 and not v.has("a")
    assert v.commit("one", replace={"a": spark.range(3)}) and not v.commit("one", replace={"a": spark.range(9)})
    bad = spark.range(2).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        v.commit("two", replace={"a": spark.range(1), "b": bad})
    assert v.table("a").count() == 3 and not v.has("b")
    v.commit("three", append={"a": spark.range(2)})
    assert v.table("a").count() == 5
    other = Versions(spark, str(tmp_path))
    old = v.manifest()
    other.commit("four", replace={"a": spark.range(1)})
    v.manifest = lambda: old
    with pytest.raises(RuntimeError, match="another run"):
        v.commit("five", replace={"a": spark.range(7)})
    assert other.table("a").count() == 1


def test_alert_runs_reconcile(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 7, i, rng.randrange(10 * DAY), rng.choice(["none", "low", "medium", "high", "critical", None]), round(rng.random() * 10, 2)) for i in range(300)]
    alerts = spark.createDataFrame(rows, "market_pk long, alert_pk long, created_us long, severity string, score double")
    tiers = spark.createDataFrame([(i, "hot") for i in range(5)], "market_pk long, tier string")
    counts = alerts.groupBy("market_pk").agg(F.count("*").alias("alerts"), F.count_if(F.col("severity").isin("high", "critical")).alias("high_alerts"))
    v = Versions(spark, str(tmp_path))
    v.commit("start", replace={"alerts": alerts, "counts": counts})
    runs = [("r1", 3 * DAY, ["low", "none"]), ("r2", 7 * DAY, ["low", "none", "medium"]), ("r3", 7 * DAY, ["high"])]
    for run in runs:
        assert upkeep.alert_retention(v, run[0], tiers, *run[1:])
        before = v.manifest()
        assert not upkeep.alert_retention(v, run[0], tiers, *run[1:]) and v.manifest() == before
    left, gone, counter = [], [], {m: sum(r[0] == m for r in rows) for m in range(7)}
    high = {m: sum(r[0] == m and r[3] in ("high", "critical") for r in rows) for m in range(7)}
    todo = rows
    for _, cutoff, kinds in runs:
        hit = [r for r in todo if r[2] < cutoff and r[3] in kinds]
        todo = [r for r in todo if r not in hit]
        gone += hit
        for m in range(7):
            n = sum(r[0] == m for r in hit)
            counter[m] = max(counter[m] - n, high[m], 0) if n else counter[m]
    left = todo
    assert sorted(r.alert_pk for r in v.table("alerts").collect()) == sorted(r[1] for r in left)
    assert {r.alert_pk: r.tier for r in v.table("alert_evidence").collect()} == {r[1]: "hot" if r[0] < 5 else None for r in gone if r[3] not in ("none", "low") or r[4] >= 7}
    days = v.table("alert_days").collect()
    assert sum(r.alerts for r in days) == len(gone)
    for r in days:
        mine = [x for x in gone if x[0] == r.market_pk and x[2] // DAY == r.day and x[3] == r.severity]
        newest = max(mine, key=lambda x: (x[2], x[1]))
        assert r.alerts == len(mine) and abs(r.avg_score - sum(x[4] for x in mine) / len(mine)) < 1e-5 and r.max_score == max(x[4] for x in mine) and r.latest_pk == newest[1]
    assert {r.market_pk: r.alerts for r in v.table("counts").collect()} == counter


def test_trade_runs(spark, tmp_path):
    trade = "market_pk long, trade_pk long, ts_us long, yes_price double, no_price double, count double, taker_side string"
    trades = spark.createDataFrame([(m, 10 * m + i, i, 0.5, 0.5, 1.0, "yes") for m in range(4) for i in range(5)], trade)
    flags = spark.createDataFrame([(m, 10 * m, 1, 5.0 + m, "medium") for m in range(4)], "market_pk long, trade_pk long, scorer_version int, score double, severity string")
    tiers = spark.createDataFrame([(0, "observe_only", 0), (1, "sampled", 0), (2, "case", 0), (3, "hot", 99 * DAY)], "market_pk long, tier string, close_us long")
    v = Versions(spark, str(tmp_path))
    v.commit("start", replace={"trades": trades, "flags": flags})
    assert upkeep.trade_retention(v, "r1", tiers, 2 * DAY) and not upkeep.trade_retention(v, "r1", tiers, 2 * DAY)
    assert {r.market_pk: r["count"] for r in v.table("trades").groupBy("market_pk").count().collect()} == {0: 1, 1: 5, 2: 5, 3: 5}
    assert {r.trade_pk for r in v.table("trade_evidence").collect()} == {0, 10, 20}
    lower = flags.withColumn("score", F.lit(1.0)).withColumn("severity", F.lit("low"))
    v.commit("rescored", replace={"flags": lower})
    upkeep.trade_retention(v, "r2", tiers, 20 * DAY)
    assert {r.market_pk: r["count"] for r in v.table("trades").groupBy("market_pk").count().collect()} == {0: 1, 1: 1, 2: 5, 3: 5}
    assert {(r.trade_pk, r.score, r.severity) for r in v.table("trade_evidence").collect()} == {(0, 5.0, "low"), (10, 6.0, "low"), (20, 7.0, "low")}


def bars_of(df):
    return {(r.market_id, r.bucket): tuple(round(x, 9) if isinstance(x, float) else x for x in r[2:]) for r in df.collect()}


def test_late_rows_are_replayed(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"m{i % 3}", rng.randrange(5000) * 1_000_000, round(rng.random(), 3), float(i % 5)) for i in range(300)]
    schema = "market_id string, ts_us long, yes_price double, count double"
    v, width = Versions(spark, str(tmp_path)), 300_000_000
    write = late.bar_sink(v, "bars", width, 1_000_000_000)
    for n in range(6):
        batch = spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema)
        write(batch, n)
        if n % 2:
            write(batch, n)
    assert v.table("late_prints").count() > 0
    assert late.replay_late(v, "replay", width) and not late.replay_late(v, "replay", width)
    assert v.table("late_prints").count() == 0
    whole = late.merged_bars(late.bar_parts(spark.createDataFrame(rows, schema), width))
    assert bars_of(late.merged_bars(v.table("bar_parts"))) == bars_of(whole)


def test_run_log_and_states(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.append([{"key": "a", "status": "starting", "at_us": 1, "run": "1"}, {"key": "a", "at_us": 5, "count": 7, "success": True, "run": "1"}])
    log.append([{"key": "b", "at_us": 9, "error": "x" * 5000, "run": "2", "metadata": {"k": 1}}])
    got = {r.key: r for r in reads.job_states(log.read(), 100, 10).collect()}
    assert got["a"].status == "running" and got["a"]["count"] == 7 and got["a"].last_success_us == 5 and got["a"].health == "healthy"
    assert got["b"].status == "error" and len(got["b"].last_error) == 4000 and got["b"].errors == 1


def test_stream_counters_reach_the_run_log(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(k, start + timedelta(seconds=i), i % 3 > 0) for i, k in enumerate(["trade"] * 9 + ["ticker"] * 6 + ["other"] * 3)]
    frame = spark.createDataFrame(rows, "type string, ts timestamp, wanted boolean")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = RunLog(spark, str(tmp_path / "log"))
    listener = late.CounterLog(log)
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        kept = late.counted(source, "gate", "type", "wanted").where("wanted")
        query = kept.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        until = time.time() + 30
        while time.time() < until and not any(n for n in log.files.names() if n.endswith(".json") and "received" in log.files.text(n)):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    row = log.read().where("key = 'gate' AND count > 0").first()
    assert row["count"] == 18 and row.metadata["kept"] == "12" and row.metadata["dropped"] == "6"
    assert row.metadata["received_trade"] == "9" and row.metadata["dropped_trade"] == "3" and row.metadata["received_ticker"] == "6" and row.metadata["dropped_ticker"] == "2"
    assert {r.key: r.status for r in reads.job_states(log.read(), 10**12, 2 * 10**15).collect()}["gate"] == "running"
