"""The twelve retention signals, at their limits, and where they come from."""

import random

from pyspark.sql import functions as F

from tapeglass.functions import scores
from tapeglass.operators import retention

DAY = retention.DAY_US
NOW = 20 * DAY


def reasons(spark, **values):
    given = {"prior": "low", "closing": False, "v": 0.0, "oi": 0.0, "alert": False} | values
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    signal = {k: F.col(k) for k in values if k not in ("prior", "closing", "v", "oi", "alert")}
    found = scores.retention_reasons(F.col("prior"), F.col("closing"), F.col("v"), F.col("oi"), F.col("alert"), signal)
    got = row.select(found.alias("r")).withColumn("s", scores.retention_score(F.col("r"))).first()
    return got.r, got.s


def test_each_signal_at_its_limit(spark):
    everything = {"prior": "high", "closing": True, "v": 250.0, "oi": 200.0, "alert": True, "severe": True, "price_zscore": 3.0, "burst_score": 3.0, "news_score": 0.75, "pre_news_move": True, "l2_pull_score": 3.0}
    found, points = reasons(spark, **everything)
    assert found == [k for k in scores.SIGNALS if k != "medium_prior"] and points == 30 + 20 + 15 + 10 + 35 + 40 + 25 + 25 + 30 + 40 + 20
    below = {"price_zscore": 2.99, "burst_score": 2.99, "news_score": 0.74, "pre_news_move": False, "l2_pull_score": 2.99, "severe": False}
    assert reasons(spark, prior="medium", **below) == (["medium_prior"], 10)
    assert reasons(spark) == ([], 0)


def test_signals_come_from_the_tables(spark):
    rng = random.Random(1)
    trades = [(1, i, 10 * DAY + i * 60_000_000, 0.5, 10.0, "yes") for i in range(40)] + [(1, 99, 11 * DAY, 0.9, 10.0, "yes")]
    trades += [(2, 200 + i, 10 * DAY + i, 0.4, 1.0, None) for i in range(8)] + [(2, 300 + i, 12 * DAY + i * 60_000_000, 0.4, 1.0, "no") for i in range(8)]
    t = spark.createDataFrame(trades, "market_pk long, trade_pk long, ts_us long, yes_price double, count double, taker_side string")
    book = spark.createDataFrame([(3, 1, 10 * DAY, -9.0, False), (3, 2, 10 * DAY + 1, 2.0, False), (3, 3, 10 * DAY, -99.0, True)], "market_pk long, seq long, received_us long, delta double, is_snapshot boolean")
    alerts = spark.createDataFrame([(1, "critical", NOW), (2, "critical", NOW - DAY), (3, "high", NOW)], "market_pk long, severity string, created_us long")
    links = spark.createDataFrame([(7, 1, 10 * DAY + DAY // 2, 0.8), (8, 2, 10 * DAY + 5, 0.9), (9, 2, 12 * DAY + DAY // 2, 0.54)], "news_id long, market_pk long, news_us long, relevance double")
    got = {r.market_pk: r for r in retention.tier_signals(t, book, alerts, links, NOW).collect()}
    assert got[1].severe and got[2].severe is None and got[3].severe is None
    assert got[1].price_zscore >= 3 and got[2].price_zscore is None and got[2].burst_score > 3 > got[1].burst_score
    assert got[1].news_score == 0.8 and got[1].pre_news_move and got[2].pre_news_move is False and got[3].l2_pull_score == 4.5
    prints = [(1, i, rng.randrange(6 * DAY), 0.5, float(rng.randrange(1, 9)), rng.choice(["yes", "no", None])) for i in range(400)]
    news = [(i, 1, rng.randrange(7 * DAY), rng.choice([0.5, 0.55, 0.9])) for i in range(30)]
    for news_id, _, at, rel in news:
        inside = [p for p in prints if at - DAY <= p[2] < at]
        want = rel >= 0.55 and len(inside) >= 5 and abs(sum(p[4] if p[5] == "yes" else -p[4] if p[5] == "no" else 0 for p in inside)) >= 0.4 * sum(p[4] for p in inside)
        if news_id % 5 == 0 and rel >= 0.55:
            one = spark.createDataFrame([(news_id, 1, at, rel)], links.schema)
            assert retention.pre_news_moves(spark.createDataFrame(prints, t.schema), one).first().pre_news_move == want
