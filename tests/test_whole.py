"""Queries that leave no sibling, print or flag out, on rows of their own."""

import datetime
import json
import random
from collections import Counter
from statistics import median

import duckdb
import pytest

from tapeglass.operators import timejoin
from tapeglass.plans import flagging
from tapeglass.plans.registry import QUERIES, SQL

MINUTE = 60_000_000
START = datetime.datetime(2024, 1, 1, 6)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_moves_of_all_siblings_are_those_of_all_pairs(spark, monkeypatch, chunk):
    """Ties, missing prices, markets given twice or in two events, prints at slot bounds, many chunks."""
    monkeypatch.setattr(timejoin, "CHUNK", chunk)
    rng = random.Random(5)
    events = [(m, rng.choice(["a", "b", None])) for m in range(60)] + [(3, "a"), (4, "b"), (5, "a"), (5, "a")]
    times = [None, *(k * 5 * MINUTE + s for k in range(-3, 27) for s in (-1, 0, 1))]
    trades = [(rng.choice([*range(62), None]), t, rng.choice(times)) for t in range(500)]
    points = [(rng.randrange(60), rng.choice(times), i, rng.choice([None, 0.5, round(rng.random(), 2)])) for i in range(1500)]
    known = {m: sorted((ts, pk, ref) for x, ts, pk, ref in points if x == m and ts is not None and ref is not None) for m in range(60)}

    def move(m, ts):
        old = [p for p in known[m] if ts - 15 * MINUTE <= p[0] <= ts]
        late = [p for p in known[m] if ts + 10 * MINUTE <= p[0] <= ts + 45 * MINUTE] or [p for p in known[m] if ts < p[0] <= ts + 45 * MINUTE]
        return abs(late[0][2] - old[-1][2]) if old and late else None

    want = []
    for market, trade, ts in trades:
        for i, (m, event) in enumerate(events):
            if m == market and event is not None and ts is not None:
                moves = [x for j, (n, e) in enumerate(events) if e == event and j != i and (x := move(n, ts)) is not None]
                want += [(trade, round(median(moves), 9), len(moves))] if moves else []
    found = timejoin.all_sibling_moves(
        spark.createDataFrame(trades, "market_pk long, trade_pk long, ts_us long"), spark.createDataFrame(points, "market_pk long, ts_us long, pk long, ref double"),
        spark.createDataFrame(events, "market_pk long, event_id string"),
    )
    assert max(n for *_, n in want) > 26
    assert Counter((r.trade_pk, round(r.sibling_median, 9), r.sibling_count) for r in found.collect()) == Counter(want)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


@pytest.fixture(scope="module")
def one_event(spark, tmp_path_factory):
    """An event of 70 markets, of which the first 30 stand still and the others move. Market 0 prints often."""
    d = str(tmp_path_factory.mktemp("whole"))
    at = lambda minutes: START + datetime.timedelta(minutes=1000 * minutes)
    prints = [(0, at(m), 10 + (m >= 20) * 60) for m in range(40)] + [(k, at(m), 20 if k < 30 or m < 20 else 60) for k in range(1, 70) for m in (1, 9, 19, 31, 39)]
    prints += [(0, at(45 + k / 600), 30 + k % 7) for k in range(1300)]
    rows = [(3 * i, k, ts, "click", 95.0 + i % 9, json.dumps({"k": price})) for i, (k, ts, price) in enumerate(prints)]
    write(spark, rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string", f"{d}/events.parquet")
    write(spark, [(k, f"Customer#{k}", 1, 1000.0, "BUILDING") for k in range(70)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", f"{d}/customer.parquet")
    write(spark, [(1, "PERU")], "n_nationkey int, n_name string", f"{d}/nation.parquet")
    write(spark, [(70 * i, f"title {i}", "web") for i in range(60)], "doc_id long, text string, source string", f"{d}/documents.parquet")
    return d


def test_context_reads_all_siblings(spark, one_event):
    """The median move of all markets of the event is one; that of its first markets was none."""
    moved = {r.trade_pk: r for r in flagging.context_prints(spark, one_event).collect()}[57]
    assert moved.sibling_count == 69 and moved.sibling_median == 0.4 and "coherent_event_move" in moved.context_reasons
    assert "coherent_event_move" in next(r.reasons for r in QUERIES["context_scores"](spark, one_event).collect() if r.trade_pk == 57).split(",")
    assert "coherent_event_move" in next(r.reasons for r in QUERIES["trade_flags"](spark, one_event).collect() if r.trade_pk == 57).split(",")
    first = {r.trade_pk: r for r in QUERIES["sibling_moves"](spark, one_event).collect()}[57]
    assert first.sibling_count == 25 and first.sibling_median == 0  # this query's job


@pytest.mark.parametrize("name", ["context_scores", "trade_flags", "case_windows", "reason_counts", "sibling_moves", "tier_promotions", "suspicious_prints"])
def test_whole_queries_equal_their_sql(spark, one_event, name):
    con = duckdb.connect()
    for table in ("events", "customer", "nation", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{one_event}/{table}.parquet/*.parquet'")
    con.sql("SET TimeZone = 'UTC'")
    want, found = con.sql(SQL[name]), QUERIES[name](spark, one_event)
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    rows = [Counter(tuple(plain(v) for v in r) for r in t) for t in (found.select(*want.columns).collect(), want.fetchall())]
    assert rows[0] == rows[1] and rows[0]


def test_every_print_before_the_news_is_scored(spark, one_event):
    """Market 0 has 1340 prints before the news; the links used to read the earliest 1000."""
    evaluated = [r.evaluated for r in QUERIES["news_correlations"](spark, one_event).collect()]
    assert max(evaluated) == 1340
    assert sum(r.prints for r in QUERIES["correlation_summary"](spark, one_event).collect()) == sum(evaluated)


def test_reasons_of_all_flags_are_counted(spark, one_event):
    """There are more than 500 flags."""
    flags = QUERIES["trade_flags"](spark, one_event).collect()
    assert len(flags) > 500
    want = Counter(reason for r in flags if r.reasons for reason in r.reasons.split(","))
    assert {r.reason: r.flags for r in QUERIES["reason_counts"](spark, one_event).collect()} == want
