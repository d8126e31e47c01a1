"""Fetched JSON payloads, one per row, to typed rows: market metadata, news search, registers, bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET = (
    "struct<ticker:string,event_ticker:string,title:string,yes_sub_title:string,no_sub_title:string,subtitle:string,status:string,category:string,tags:array<string>,"
    "open_time:string,close_time:string,last_price_dollars:string>"
)
SEARCH = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string>>>"
REGISTER = "struct<results:array<struct<title:string,abstract:string,html_url:string,publication_date:string,agencies:array<struct<name:string>>>>>"
BILLS = "struct<bills:array<struct<title:string,type:string,number:string,url:string,updateDate:string,latestAction:struct<actionDate:string,text:string>,introducedDate:string>>>"


def filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def when_seen(text: Column) -> Column:
    """Compact or ISO time; anything else is null."""
    compact = F.regexp_replace(text, "[TZ]", "")
    return F.coalesce(F.try_to_timestamp(compact, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(text))


def parse_markets(raw: DataFrame, column: str = "value") -> DataFrame:
    """Market rows; the title falls back to the ticker, the status to unknown, the subtitle to the
    first of three fields. Rows without a ticker are dropped."""
    m = raw.select(F.from_json(column, MARKET).alias("m")).where("m.ticker IS NOT NULL")
    return m.select(
        F.col("m.ticker").alias("market_id"), F.col("m.event_ticker").alias("event_id"), F.coalesce(filled(F.col("m.title")), F.col("m.ticker")).alias("title"),
        F.coalesce(*[filled(F.col(f"m.{f}")) for f in ("yes_sub_title", "no_sub_title", "subtitle")]).alias("subtitle"),
        F.coalesce(filled(F.col("m.status")), F.lit("unknown")).alias("status"), filled(F.col("m.category")).alias("category"), F.col("m.tags").alias("tags"),
        F.try_to_timestamp("m.open_time").alias("open_time"), F.try_to_timestamp("m.close_time").alias("close_time"), F.col("m.last_price_dollars").try_cast("decimal(12,4)").alias("last_price"),
    )


def parse_search(raw: DataFrame, column: str = "value") -> DataFrame:
    """Articles of a news search; those without an address are dropped."""
    a = raw.select(F.explode(F.from_json(column, SEARCH)["articles"]).alias("a")).where(filled(F.col("a.url")).isNotNull())
    domain = F.lower(F.coalesce(filled(F.col("a.domain")), F.parse_url(F.trim("a.url"), F.lit("HOST"))))
    return a.select(F.trim("a.url").alias("url"), filled(F.col("a.title")).alias("title"), domain.alias("domain"), F.col("a.language").alias("language"), when_seen(F.col("a.seendate")).alias("seen_at"))


def parse_register(raw: DataFrame, column: str = "value", terms: tuple[str, ...] = ("regulation",)) -> DataFrame:
    """Register entries; the words of the first five agencies join the keywords."""
    r = raw.select(F.explode(F.from_json(column, REGISTER)["results"]).alias("r")).where("r.html_url IS NOT NULL")
    names = F.transform(F.slice(F.coalesce("r.agencies", F.array()), 1, 5), lambda x: F.lower(F.coalesce(x["name"], F.lit(""))))
    words = F.filter(F.flatten(F.transform(names, lambda n: F.split(n, r"\s+"))), lambda w: w != "")
    keywords = F.array_distinct(F.concat(F.array(*[F.lit(t) for t in terms]), words))
    return r.select(F.col("r.html_url").alias("url"), F.col("r.title").alias("title"), F.col("r.abstract").alias("summary"), keywords.alias("keywords"), when_seen(F.col("r.publication_date")).alias("published_at"))


def parse_bills(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bill updates; the title falls back to type and number, the date over three fields."""
    b = raw.select(F.explode(F.from_json(column, BILLS)["bills"]).alias("b"))
    title = F.coalesce(filled(F.col("b.title")), filled(F.concat_ws(" ", "b.type", "b.number")))
    day = F.coalesce(*[when_seen(F.col(f"b.{f}")) for f in ("updateDate", "latestAction.actionDate", "introducedDate")])
    return b.select(F.col("b.url").alias("url"), title.alias("title"), F.col("b.latestAction.text").alias("summary"), day.alias("published_at"))
