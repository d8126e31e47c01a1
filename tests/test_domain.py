import json
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeglass.functions import scores
from tapeglass.operators import alerts, bars, classify, folds, merge, news, retention, stats, tape, timejoin
from tapeglass.sources import adapters, messages
from tapeglass.streaming import jobs

TRADE = "market_pk long, trade_pk long, ts_us long, yes_price double, no_price double, count decimal(18,2), taker_side string"


def prints(spark, rows):
    """rows: (market, trade, seconds, yes price, count, side)."""
    from decimal import Decimal

    made = [(m, t, int(s * 1e6), p, None if p is None else 1 - p, None if c is None else Decimal(str(c)), side) for m, t, s, p, c, side in rows]
    return spark.createDataFrame(made, TRADE)


def test_flat_tape_scores_low_and_a_whale_high(spark):
    flat = [(1, i, 60 * i, 0.5, 10, "yes" if i % 2 else "no") for i in range(15)]
    whale = [(2, 100 + i, 60 * i, 0.5, 3 + i % 5, "yes" if i % 2 else "no") for i in range(20)] + [(2, 200, 1300, 0.5, 2000, "yes")]
    got = {r.trade_pk: r for r in tape.score_prints(prints(spark, flat + whale)).collect()}
    assert all(got[i].score < 0.1 for i in range(3, 15))
    assert got[200].score > 1 and "large_size_vs_recent" in got[200].reasons


def test_nulls_take_no_place_in_history(spark):
    rows = [(1, i, i, 0.5, None if i % 2 else 10, None) for i in range(12)] + [(1, 50, 60, None, None, "yes")]
    got = {r.trade_pk: r for r in tape.score_prints(prints(spark, rows)).collect()}
    assert got[50].score is None and got[50].reasons is None
    assert got[10].size_z == 0.0


def test_same_side_cluster(spark):
    rows = [(1, i, 20 * i, 0.5, 1, "yes" if i % 2 else "no") for i in range(6)] + [(1, 10 + i, 200 + i, 0.5, 1, "yes") for i in range(6)]
    got = {r.trade_pk: r for r in tape.score_prints(prints(spark, rows)).collect()}
    assert got[15].cluster >= 1.5 and 0 < got[15].score < 2
    assert "same_side_cluster" in got[15].reasons


def brute_bursts(rows, window=30):
    out = {}
    for i, a in enumerate(rows):
        inside = [b for b in rows[i:] if b[2] - a[2] <= window]
        out[a[1]] = (len(inside), sum(b[5] == "yes" for b in inside), sum(b[5] == "no" for b in inside))
    return out


def test_bursts_with_tied_times(spark):
    rows = [(1, i, s, 0.5, 1, side) for i, (s, side) in enumerate([(0, "yes"), (0, "yes"), (0, "no"), (10, None), (31, "yes"), (31, "no"), (90, "no")])]
    found = tape.burst_prints(prints(spark, rows))
    assert {r.trade_pk: (r.window_count, r.yes_count, r.no_count) for r in found.collect()} == brute_bursts(rows)
    assert tape.burst_summary(found).first().largest_window == 4


def test_asof_and_follow_through(spark):
    quotes = spark.createDataFrame([(1, 1, 0, 0.50, 0.58), (1, 2, 5_000_000, 0.51, 0.59), (2, 3, 0, 0.1, 0.2)], "market_pk long, quote_pk long, ts_us long, yes_bid double, yes_ask double")
    rows = [(1, 1, 0, 0.50, 5, "yes"), (1, 2, 4, 0.51, 5, "yes"), (1, 3, 5, 0.57, 120, "yes"), (1, 4, 400, 0.62, 5, "yes"), (3, 5, 1, 0.3, 1, None)]
    got = {r.trade_pk: r for r in timejoin.quote_at_or_before(prints(spark, rows), quotes, ["yes_bid", "yes_ask"]).collect()}
    assert [got[i].yes_bid for i in (1, 2, 3, 4, 5)] == [0.50, 0.50, 0.51, 0.51, None]
    later = {r.trade_pk: r.later_price for r in timejoin.follow_through(prints(spark, rows)).collect()}
    assert later == {1: 0.62, 2: 0.62, 3: 0.62, 4: 0.62, 5: 0.3}


def test_news_joins_equal_a_scan(spark):
    hour = 3600
    rows = [(1, i, i * 5 * hour, 0.5, 1, None) for i in range(40)]
    news_rows = [(1, 100 + i, i * 31 * hour * 1_000_000, (i % 4) / 4) for i in range(8)]
    links = spark.createDataFrame(news_rows, "market_pk long, news_id long, news_us long, relevance double")
    for after, hours, least in ((True, 72, 0.45), (False, 24, 0.55)):
        got = {r.trade_pk: r.news_id for r in timejoin.news_within(prints(spark, rows), links, hours, least, after).collect()}
        for _, t, s, *_ in rows:
            near = [((n[2] / 1e6 - s) * (1 if after else -1), n[1]) for n in news_rows if n[3] >= least]
            near = [x for x in near if 0 <= x[0] <= hours * hour]
            assert got[t] == (min(near)[1] if near else None)


def test_bars_of_bars_equal_bars(spark, data_dir):
    t, q = adapters.trades(spark, data_dir), adapters.quotes(spark, data_dir)
    small = bars.merge_bars(bars.price_bars(t, q, 300), 3600)
    wide = bars.price_bars(t, q, 3600)
    columns = [c for c in wide.columns if c != "at_us"]
    assert Counter(map(tuple, small.select(columns).collect())) == Counter(map(tuple, wide.select(columns).collect()))
    total = wide.agg(F.sum("trade_count"), F.sum("quote_count")).first()
    assert tuple(total) == (t.count(), q.count())


def test_peer_baselines(spark):
    rows = prints(spark, [(i % 3, i, i, 0.01 * (i % 7), 1 + i, None) for i in range(30)])
    named = rows.withColumn("category", F.lit("politics")).withColumn("subcategory", F.when(F.col("market_pk") == 0, F.lit("x")))
    got = {(r.category, r.subcategory): r for r in stats.peer_baselines(named).collect()}
    assert got["politics", "*"].sample_size == 30 and got["politics", "*"].count_p95 == pytest.approx(28.55)
    assert ("politics", "x") not in got  # ten points only


def test_merge_rules_and_replay(spark):
    old = spark.createDataFrame([(1, 5, 10, "a"), (2, 1, 1, None)], "k long, n long, last long, tag string")
    new = spark.createDataFrame([(2, 3, 9, "b"), (3, 1, 4, "c"), (None, 7, 7, "d")], "k long, n long, last long, tag string")
    got = {r.k: tuple(r)[1:] for r in merge.merge_upsert(old, new, ["k"], {"n": "add", "last": "greatest", "tag": "coalesce_old_new"}).collect()}
    assert got == {1: (5, 10, "a"), 2: (4, 9, "b"), 3: (1, 4, "c"), None: (7, 7, "d")}
    once = merge.insert_absent(old, new.where("k IS NOT NULL"), ["k"])
    assert sorted(r.k for r in merge.insert_absent(once, new.where("k IS NOT NULL"), ["k"]).collect()) == [1, 2, 3]
    changes = {r.change: r.rows for r in merge.row_changes(old, spark.createDataFrame([(1, 5, 10, "a"), (2, 2, 1, None), (9, 0, 0, "z")], old.schema), ["k"]).collect()}
    assert changes == {"unchanged": 1, "changed": 1, "inserted": 1}


def test_retention_keeps_and_prunes_everything_once(spark, data_dir):
    t = adapters.trades(spark, data_dir)
    activity = t.groupBy("market_pk").agg(F.sum("count").alias("volume_24h"), F.sum("count").alias("open_interest"), F.lit(False).alias("has_alert"))
    tiers = retention.market_tiers(adapters.markets(spark, data_dir), activity, adapters.NOW_US)
    plan = retention.prune_plan(t, tiers, t.where("count > 90"), adapters.NOW_US + 20 * retention.DAY_US)
    assert plan.count() == t.count() == plan.select("trade_pk").distinct().count()
    assert plan.where("pruned").join(t.where("count > 90"), "trade_pk", "left_semi").count() == 0


@pytest.mark.parametrize(
    ("points", "tier", "hours"), [(110, "case", None), (80, "triggered", 720), (79, "hot", 168), (20, "sampled", 24), (0, "observe_only", 1), (-1, "ignored", None)]
)
def test_tiers(spark, points, tier, hours):
    row = spark.range(1).select(scores.storage_tier(F.lit(points)).alias("t"), scores.raw_ttl_hours(F.lit(points)).alias("h")).first()
    assert (row.t, row.h) == (tier, hours)


def test_lifecycle_and_labels(spark):
    now = adapters.NOW_US
    rows = [("KXKING-24JAN02-Q", "active", None), ("KXKING-24FEB30-Q", "active", None), ("KXA", "open", now + 1), ("KXA", "closed", None), ("KXA", None, None), ("KXA", "unknown", None)]
    df = spark.createDataFrame(rows, "id string, status string, close_us long")
    stale = scores.stale_event(F.col("id"), now)
    got = [r[0] for r in df.select(scores.lifecycle(F.col("status"), F.col("close_us"), stale, now)).collect()]
    assert got == ["historical", "active", "active", "historical", "other", "unknown"]
    codes = spark.createDataFrame([("Wide  spread (>0.10)!",), ("***",)], "r string").select(scores.reason_code(F.col("r")).alias("c")).collect()
    assert [r.c for r in codes] == ["wide_spread_0_10", "unknown"]
    share = spark.range(20_000).select(scores.keyed_sample(F.col("id").cast("string"), F.lit(0.1)).alias("s")).agg(F.avg(F.col("s").cast("int"))).first()[0]
    assert share == pytest.approx(0.1, abs=0.01)


def test_messages(spark):
    raw = [
        {"type": "trade", "msg": {"market_ticker": "A", "trade_id": "1", "ts_ms": 1000, "yes_price_dollars": "0.55", "count_fp": "", "taker_side": "YES"}},
        {"type": "trade", "msg": {"market_ticker": "A", "ts_ms": 1000}},
    ]
    good, bad = messages.parse_trades(spark.createDataFrame([(json.dumps(x),) for x in raw] + [("not json",)], "value string"))
    row = good.first()
    assert (row.trade_id, float(row.yes_price), row["count"], row.taker_side) == ("1", 0.55, None, "yes") and bad.count() == 2
    book = [
        {"type": "orderbook_snapshot", "seq": 1, "msg": {"market_ticker": "A", "ts_ms": 1, "yes_dollars_fp": [["0.1", "5"], ["0.2"]], "no_dollars_fp": [["0.8", "7"]]}},
        {"type": "orderbook_delta", "seq": 2, "msg": {"market_ticker": "A", "ts_ms": 1, "side": "yes", "price_dollars": "0.1", "delta_fp": "-3"}},
        {"type": "orderbook_delta", "seq": 3, "msg": {"market_ticker": "A", "ts_ms": 1, "side": "maybe", "price_dollars": "0.1", "delta_fp": "-3"}},
    ]
    levels = messages.parse_book(spark.createDataFrame([(json.dumps(x),) for x in book], "value string")).collect()
    assert sorted((r.seq, r.side, r.is_snapshot) for r in levels) == [(1, "no", True), (1, "yes", True), (2, "yes", False)]
    ticker = [{"type": "ticker", "seq": 4, "msg": {"market_ticker": "A", "ts_ms": 1, "volume": "12", "volume_fp": ""}}, {"type": "ticker", "msg": {}}]
    quotes = messages.parse_tickers(spark.createDataFrame([(json.dumps(x),) for x in ticker], "value string")).collect()
    assert len(quotes) == 1 and float(quotes[0].volume) == 12


def test_feed_items(spark):
    xml = "<rss><channel><item><title>Rates & risk</title><link> http://x/1 </link><description>&lt;p&gt;Cut&lt;/p&gt; soon</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>"
    row = news.feed_items(spark.createDataFrame([("f", "wire", xml)], "feed_url string, source_tier string, xml_text string")).first()
    assert (row.title, row.link, row.summary) == ("Rates & risk", "http://x/1", "Cut soon")
    assert row.published == datetime(2024, 1, 1, 10)


def test_streams_equal_batches(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("A", str(i % 25), start + timedelta(seconds=20 * (i % 25)), 0.4 + 0.01 * (i % 5), 1.0) for i in range(50)]  # each print twice
    frame = spark.createDataFrame(rows, "market_id string, trade_id string, ts timestamp, yes_price double, count double")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = jobs.new_prints(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == 25
    query = jobs.live_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in jobs.live_bars(frame).collect()}
    assert {tuple(r) for r in spark.table("bars").collect()} == want


def test_diversified_keeps_the_rules(spark):
    rows = [(i % 4, i, i, 10.0 - i * 0.1, ["sports_outcome", "politics", "macro"][i % 3], f"e{i % 5}") for i in range(60)]
    flags = spark.createDataFrame(rows, "market_pk long, trade_pk long, ts_us long, score double, category string, event_id string")
    got = alerts.diversified(flags, 10).orderBy("place").collect()
    assert len(got) == 10 and [r.place for r in got] == list(range(1, 11))
    assert [r.trade_pk for r in got[:3]] == [0, 1, 2]  # different markets, best scores
    sports = [r for r in got if r.category == "sports_outcome"]
    assert len(sports) <= 4 and len({r.event_id for r in sports}) == len(sports)


def greedy(rows, limit, sports):
    ordered = sorted(rows, key=lambda r: (-r[3], -r[2], r[1]))[: max(25 * limit, 300)]
    chosen = []
    for strict in (True, False):
        for r in ordered:
            sport, event = r[4] in sports, r[5] or f"m{r[0]}"
            mine = [c for c in chosen if c[4] in sports]
            if len(chosen) >= limit or r in chosen or (sport and (len(mine) >= min(limit, 4) or event in [c[5] or f"m{c[0]}" for c in mine])):
                continue
            if strict and (r[0] in [c[0] for c in chosen] or [c[4] for c in chosen].count(r[4]) >= 3):
                continue
            chosen.append(r)
    return [r[1] for r in chosen]


@pytest.mark.parametrize("seed", range(4))
def test_diversified_equals_a_plain_loop(spark, seed):
    import random

    rng = random.Random(seed)
    kinds = ["sports_outcome", "sports_prop", "politics", "macro", None]
    rows = [(rng.randrange(9), i, rng.randrange(5), rng.randrange(20) / 2, rng.choice(kinds), rng.choice([None, "a", "b", "c"])) for i in range(80)]
    flags = spark.createDataFrame(rows, "market_pk long, trade_pk long, ts_us long, score double, category string, event_id string")
    got = [r.trade_pk for r in alerts.diversified(flags, 12).orderBy("place").collect()]
    assert got == greedy(rows, 12, alerts.SPORTS)
    assert alerts.diversified(flags.where("score > 99"), 5).collect() == []


def test_sports_flags_without_an_event_count_by_market(spark):
    rows = [(i, i, i, 5.0, "sports_prop", None) for i in range(5)] + [(0, 9, 9, 4.0, "sports_prop", None)]
    flags = spark.createDataFrame(rows, "market_pk long, trade_pk long, ts_us long, score double, category string, event_id string")
    assert len(alerts.diversified(flags, 10).collect()) == 4


def test_alerts_on_a_jump(spark):
    quotes = [(1, i, i * 1_000_000, 0.45, 0.55, None, 100.0) for i in range(11)] + [(1, 20, 99_000_000, 0.60, 0.90, None, 160.0), (2, 30, 0, 0.4, 0.5, None, 1.0)]
    df = spark.createDataFrame(quotes, "market_pk long, quote_pk long, ts_us long, yes_bid double, yes_ask double, last_price double, volume double")
    got = {r.market_pk: r for r in alerts.market_alerts(df).collect()}
    assert got[1].severity == "high" and set(got[1].reasons) == {"wide spread", "sharp price move", "large volume jump"}
    assert (got[2].score, got[2].severity, got[2].reasons) == (0.0, "none", ["limited history"])


def test_folds_equal_plain_loops(spark, data_dir):
    rows = adapters.quotes(spark, data_dir).select("market_pk", "quote_pk", "ts_us", (F.col("last_price").isNotNull()).alias("priced"), F.round("yes_bid", 1).alias("yes_bid"))
    plain = sorted(rows.collect(), key=lambda r: (r.market_pk, r.ts_us, r.quote_pk))
    passed, last = set(), {}
    for r in plain:
        if r.market_pk not in last or r.ts_us - last[r.market_pk] >= 60_000_000 or r.priced:
            passed.add(r.quote_pk)
            last[r.market_pk] = r.ts_us
    assert {r.quote_pk for r in folds.throttle(rows, ["market_pk"], ["ts_us", "quote_pk"], 60_000_000, "priced").collect()} == passed
    stored, last = set(), {}
    for r in plain:
        old = last.get(r.market_pk)
        if old is None or r.ts_us - old.ts_us >= 300_000_000 or abs(r.yes_bid - old.yes_bid) > 1e-4:
            stored.add(r.quote_pk)
            last[r.market_pk] = r
    assert {r.quote_pk for r in folds.suppress_unchanged(rows, ["yes_bid"], []).collect()} == stored


def test_episodes(spark):
    minute = 60_000_000
    rows = [(1, 1, 0, "low", 3.5), (1, 2, minute, "low", 4.0), (1, 3, 2 * minute, "high", 6.0), (1, 4, 3 * minute, "low", 3.0), (1, 5, 4 * minute, "medium", 4.0), (1, 6, 40 * minute, "low", 3.1), (2, 7, 0, "low", 1.0)]
    df = spark.createDataFrame(rows, "market_pk long, alert_pk long, created_us long, severity string, score double")
    got = {r.alert_pk: r.action for r in folds.alert_episodes(df).collect()}
    assert got == {1: "created", 2: "updated", 3: "created", 4: "updated", 5: "created", 6: "created"}


def test_episode_deleted_on_the_same_quote(spark):
    rows = [(1, 1, 0, "low", 4.0, 7), (1, 2, 1, "low", 1.0, 8), (1, 3, 2, "odd", None, 7), (1, 4, 3, "low", 5.0, 9)]
    df = spark.createDataFrame(rows, "market_pk long, alert_pk long, created_us long, severity string, score double, quote_pk long")
    assert {r.alert_pk: r.action for r in folds.alert_episodes(df).collect()} == {1: "created", 3: "deleted", 4: "created"}


def test_layers_and_priors(spark):
    def struct(category, confidence):
        return F.struct(F.lit(category).alias("category"), F.lit("x").alias("subcategory"), F.lit("r").alias("rule"), F.lit(confidence).alias("confidence"), F.lit("").alias("tags"))

    none = F.when(F.lit(False), struct("", "low"))
    cases = [([none, struct("b", "medium"), struct("c", "high")], "b"), ([struct("a", "low"), struct("b", "low")], "b"), ([struct("a", "low"), none], "a"), ([none], "other")]
    for layers, want in cases:
        assert classify.classify(spark.range(1), layers).first().category == want
    row = classify.classify(spark.range(1), [struct("judicial", "low")]).first()
    assert row.prior == "medium"
    assert spark.range(1).select(classify.prior_of(F.lit("weather"), F.lit("fog"))).first()[0] == "very_low"
    assert spark.range(1).select(classify.prior_of(F.lit("what"), F.lit(None).cast("string"))).first()[0] == "medium"
