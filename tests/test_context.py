"""Small fixtures of the contextual score, news correlation, payloads and filters."""

import json

from pyspark.sql import functions as F

from tapeglass.functions import filters
from tapeglass.operators import context, reads
from tapeglass.sources import payloads


def test_context_caps(spark):
    rows = [(None, 0.0), (5.0, 0.0), (5.0, 3.0), (50.0, 1.0), (120.0, 3.0), (120.0, 0.0), (900.0, 3.0)]
    df = spark.createDataFrame(rows, "dollars double, cluster double")
    got = [r[0] for r in df.select(context.context_cap(F.col("dollars"), F.col("cluster"))).collect()]
    assert got == [None, 1.5, 2.5, 3.5, 6.0, None, None]


def test_best_print_before_news(spark):
    noon, minute = 43_200_000_000, 60_000_000
    columns = (
        "news_id long, market_pk long, news_us long, trade_pk long, ts_us long, count double, taker_side string, relevance double, label string, confidence double, "
        "direct boolean, local_score double, flag_score double, delta double, through double"
    )
    rows = [
        (1, 7, noon, 1, noon - 30 * minute, 10.0, "yes", 0.9, "supports_yes", 0.65, True, 0.0, None, 0.0, 0.05),
        (1, 7, noon, 2, noon - 10 * minute, 250.0, "yes", 0.9, "supports_yes", 0.65, True, 5.0, 4.0, 0.05, 0.13),
        (1, 7, noon, 3, noon + minute, 900.0, "yes", 0.9, "supports_yes", 0.65, True, 9.0, 9.0, 0.3, 0.3),
        (2, 7, noon, 2, noon - 10 * minute, 250.0, "yes", 0.5, "ambiguous", 0.0, False, 9.0, 9.0, 0.05, 0.13),
    ]
    got = {r.news_id: r for r in context.news_trade_scores(spark.createDataFrame(rows, columns)).collect()}
    assert (got[1].trade_pk, got[1].seconds, got[1].evaluated, got[1].status) == (2, 600, 2, "strong_pre_news_signal")
    assert (got[2].score, got[2].status) == (3.999, "no_pre_news_signal")  # a weak ambiguous link is no signal


def test_payload_fallbacks(spark):
    raw = [json.dumps({"ticker": "A", "title": " ", "no_sub_title": "n"}), json.dumps({"title": "no ticker"}), "broken"]
    got = payloads.parse_markets(spark.createDataFrame([(r,) for r in raw], "value string")).collect()
    assert [(r.market_id, r.title, r.subtitle, r.status, r.close_time) for r in got] == [("A", "A", "n", "unknown", None)]
    agencies = [{"name": f"Agency {i}"} for i in range(7)]
    entry = json.dumps({"results": [{"title": "t", "html_url": "u", "agencies": agencies, "publication_date": "odd"}]})
    row = payloads.parse_register(spark.createDataFrame([(entry,)], "value string")).first()
    assert row.keywords == ["regulation", "agency", "0", "1", "2", "3", "4"] and row.published_at is None


def test_three_valued_scopes(spark):
    rows = [(None, None), ("active", None), ("active", 5), ("active", 50), ("closed", 50)]
    df = spark.createDataFrame(rows, "status string, close_us long")
    found = df.select(*[f(F.col("status"), F.col("close_us"), F.lit(None).cast("boolean"), 10).alias(n) for n, f in (("a", filters.active_scope), ("h", filters.historical_scope))]).collect()
    assert [(r.a, r.h) for r in found] == [(False, True), (True, False), (False, True), (True, False), (False, True)]


def test_series_of_one_point_and_gap(spark):
    rows = [(1, 0, 0.5, 3), (1, 240, 0.9, 3), (1, 240, 0.1, 2), (2, 30, None, 3), (3, 61, 2.0, 1)]
    got = {(r.market_pk, r.at): round(r.value, 6) for r in reads.uniform_series(spark.createDataFrame(rows, "market_pk long, unix long, value double, rank int")).collect()}
    assert got == {(1, 0): 0.5, (1, 60): 0.6, (1, 120): 0.7, (1, 180): 0.8, (1, 240): 0.9, (3, 60): 1.0, (3, 120): 1.0}


def test_flags_promotions_and_cases_at_their_floors(spark):
    rows = [(1, 10, 1, 2.99, None), (1, 11, 2, 3.0, None), (1, 12, 3, 6.999, None), (2, 13, 4, 7.0, None), (3, 14, 5, 8.499, None), (3, 15, 6, 8.5, None), (4, 16, 7, 7.0, ["pre_news_directional_move"]), (5, 17, 8, 5.0, None)]
    scored = spark.createDataFrame([(m, t, u * 10**6, s, 0.0, None, r, None) for m, t, u, s, r in rows], "market_pk long, trade_pk long, ts_us long, local_score double, context_score double, post_news_multiplier double, reasons array<string>, context_reasons array<string>")
    flags = context.trade_flags(scored, 1)
    got = {r.trade_pk: (r.severity, r.tier) for r in flags.collect()}
    assert got == {11: ("low", None), 12: ("medium", None), 13: ("high", "triggered"), 14: ("high", "triggered"), 15: ("critical", "case"), 16: ("high", "case"), 17: ("medium", None)}
    cases = {r.trade_pk: r for r in context.case_windows(flags).collect()}
    assert set(cases) == {15, 16} and cases[15].case_key == "trade_flag:1:15" and cases[15].end_us - cases[15].start_us == 30 * 3600 * 10**6
    tiers = spark.createDataFrame([(1, "sampled", 20), (2, "case", 120), (3, "hot", 60), (9, "hot", 50)], "market_pk long, tier string, retention_score int")
    promoted = {r.market_pk: (r.tier, r.retention_score) for r in context.promote(tiers, flags).collect()}
    assert promoted == {1: ("sampled", 20), 2: ("triggered", 120), 3: ("case", 85), 4: ("case", 70), 9: ("hot", 50)}
    assert {r.market_pk: r.tier for r in context.promote(tiers, flags, keep_case=True).collect()}[2] == "case"


def test_news_case_windows(spark):
    links = spark.createDataFrame([(1, 5, 100 * 10**9, 7.0), (2, 5, 100 * 10**9, 6.9), (3, 5, 100 * 10**9, None)], "news_id long, market_pk long, news_us long, score double")
    got = context.news_case_windows(links, 3600 * 10**6).collect()
    assert [(r.case_key, r.trigger_us - r.start_us, r.end_us - r.trigger_us) for r in got] == [("news_link:1", 3600 * 10**6, 6 * 3600 * 10**6)]
