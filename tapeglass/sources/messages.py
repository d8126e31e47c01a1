"""Exchange messages as JSON text to typed rows; rows that miss a needed field go to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRADE = "struct<type:string,seq:long,msg:struct<market_ticker:string,trade_id:string,ts_ms:long,yes_price_dollars:string,no_price_dollars:string,count_fp:string,taker_side:string>>"
TICKER = (
    "struct<type:string,seq:long,msg:struct<market_ticker:string,ts_ms:long,price_dollars:string,yes_bid_dollars:string,yes_ask_dollars:string,"
    "volume_fp:string,volume:string,volume_24h_fp:string,volume_24h:string,open_interest_fp:string,open_interest:string>>"
)
BOOK = (
    "struct<type:string,seq:long,msg:struct<market_ticker:string,ts_ms:long,yes_dollars_fp:array<array<string>>,no_dollars_fp:array<array<string>>,"
    "side:string,price_dollars:string,delta_fp:string>>"
)


def number(text: Column, kind: str) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast(kind)


def parse_trades(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(prints, quarantine): a print needs ticker, trade id and time."""
    parsed = raw.withColumn("m", F.from_json(column, TRADE))
    usable = F.col("m.msg.market_ticker").isNotNull() & F.col("m.msg.trade_id").isNotNull() & F.col("m.msg.ts_ms").isNotNull()
    good = parsed.where(usable).select(
        F.col("m.msg.market_ticker").alias("market_id"),
        F.col("m.msg.trade_id").alias("trade_id"),
        F.timestamp_millis("m.msg.ts_ms").alias("ts"),
        number(F.col("m.msg.yes_price_dollars"), "decimal(12,4)").alias("yes_price"),
        number(F.col("m.msg.no_price_dollars"), "decimal(12,4)").alias("no_price"),
        number(F.col("m.msg.count_fp"), "decimal(18,2)").alias("count"),
        F.lower("m.msg.taker_side").alias("taker_side"),
    )
    return good, parsed.where(~F.coalesce(usable, F.lit(False))).select(*raw.columns)


def parse_tickers(raw: DataFrame, column: str = "value") -> DataFrame:
    """Quotes; rows without a ticker are dropped, alternative field names fill in."""
    parsed = raw.select(F.from_json(column, TICKER).alias("m")).where("m.msg.market_ticker IS NOT NULL")

    def either(*fields: str) -> Column:
        return F.coalesce(*[number(F.col(f"m.msg.{f}"), "decimal(18,2)") for f in fields])

    return parsed.select(
        F.col("m.msg.market_ticker").alias("market_id"),
        F.col("m.seq").alias("seq"),
        F.timestamp_millis("m.msg.ts_ms").alias("ts"),
        *[number(F.col(f"m.msg.{f}_dollars"), "decimal(12,4)").alias(n) for f, n in (("price", "last_price"), ("yes_bid", "yes_bid"), ("yes_ask", "yes_ask"))],
        either("volume_fp", "volume").alias("volume"),
        either("volume_24h_fp", "volume_24h").alias("volume_24h"),
        either("open_interest_fp", "open_interest").alias("open_interest"),
    )


def parse_book(raw: DataFrame, column: str = "value") -> DataFrame:
    """(market_id, seq, ts, side, price, size, delta, is_snapshot): one row per level of a snapshot
    or per delta. Levels of fewer than two fields and deltas of other sides are dropped."""
    parsed = raw.select(F.from_json(column, BOOK).alias("m")).where("m.msg.market_ticker IS NOT NULL")

    def levels(side: str) -> Column:
        pairs = F.filter(F.coalesce(F.col(f"m.msg.{side}_dollars_fp"), F.array()), lambda x: F.size(x) >= 2)
        return F.transform(pairs, lambda x: F.struct(F.lit(side).alias("side"), x[0].alias("price"), x[1].alias("size"), F.lit(None).cast("string").alias("delta"), F.lit(True).alias("is_snapshot")))

    change = F.struct("m.msg.side", F.col("m.msg.price_dollars").alias("price"), F.lit(None).cast("string").alias("size"), F.col("m.msg.delta_fp").alias("delta"), F.lit(False).alias("is_snapshot"))
    deltas = F.when((F.col("m.type") == "orderbook_delta") & F.col("m.msg.side").isin("yes", "no"), F.array(change)).otherwise(F.array())
    rows = F.when(F.col("m.type") == "orderbook_snapshot", F.concat(levels("yes"), levels("no"))).otherwise(deltas)
    each = parsed.select("m", F.explode(rows).alias("r"))
    return each.select(
        F.col("m.msg.market_ticker").alias("market_id"), F.col("m.seq").alias("seq"), F.timestamp_millis("m.msg.ts_ms").alias("ts"), "r.side",
        number(F.col("r.price"), "decimal(12,4)").alias("price"), number(F.col("r.size"), "decimal(18,2)").alias("size"),
        number(F.col("r.delta"), "decimal(18,2)").alias("delta"), "r.is_snapshot",
    )
