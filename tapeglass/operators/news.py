"""News text jobs: keys, first copies, tokens, feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.functions.scores import canonical_url_hash

# Words that say nothing about an event, and words that are counted as another one.
STOPWORDS = [
    "a", "about", "after", "again", "against", "all", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its",
    "new", "of", "on", "or", "over", "says", "that", "the", "their", "this", "to", "toward", "towards", "will", "with",
]
SAME_WORD = {
    "advocate": "regulator",
    "advocates": "regulator",
    "appointed": "appoint",
    "appoints": "appoint",
    "appointment": "appoint",
    "asset": "asset",
    "assets": "asset",
    "chairman": "chair",
    "currency": "crypto",
    "cryptocurrency": "crypto",
    "cryptocurrencies": "crypto",
    "digital": "crypto",
    "friendlier": "friendly",
    "names": "appoint",
    "nominates": "appoint",
    "nominee": "appoint",
    "nomination": "appoint",
    "regulation": "regulator",
    "regulatory": "regulator",
}


def article_keys(articles: DataFrame) -> DataFrame:
    """(article_id, url_hash, host): the identity of an article and where it stands."""
    host = F.regexp_replace(F.lower(F.parse_url(F.trim("url"), F.lit("HOST"))), "^www[.]", "")
    return articles.select("article_id", canonical_url_hash(F.col("url")).alias("url_hash"), host.alias("host"))


def first_per_url(articles: DataFrame) -> DataFrame:
    """The first seen copy of each normalised URL."""
    key = F.lower(F.trim("url"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first_seen_us", "article_id"))
    return articles.withColumn("place", place).where("place = 1").drop("place")


def tokens(text: Column) -> Column:
    """Distinct words of three letters and more without stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def one_form(word: Column) -> Column:
    """A word's common form: its other word, then without a plural s that word's other word."""
    other = F.create_map(*[F.lit(x) for pair in SAME_WORD.items() for x in pair])
    known = lambda w: F.coalesce(F.try_element_at(other, w), w)
    plural = (F.length(known(word)) > 4) & F.endswith(known(word), F.lit("s"))
    return F.when(plural, known(F.substring(known(word), F.lit(1), F.length(known(word)) - 1))).otherwise(known(word))


def cluster_tokens(text: Column) -> Column:
    """The words of :func:`tokens` and their common forms, distinct."""
    words = tokens(text)
    forms = F.filter(F.transform(words, one_form), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    return F.array_union(words, forms)


def article_tokens(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", "first_seen_us", cluster_tokens(F.concat_ws(" ", "title", "summary")).alias("tokens"))


def feed_items(payloads: DataFrame) -> DataFrame:
    """(feed_url, title, link, summary, published) of RSS items, one payload per row; bare
    ampersands are repaired and tags stripped."""
    fixed = F.regexp_replace("xml_text", "&(?!(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);)", "&amp;")
    item = "array<struct<title:string,link:string,description:string,pubDate:string>>"
    parsed = payloads.select("feed_url", "source_tier", F.from_xml(fixed, f"struct<channel:struct<item:{item}>>").alias("rss"))
    each = parsed.select("feed_url", "source_tier", F.explode("rss.channel.item").alias("i"))
    text = F.trim(F.regexp_replace(F.regexp_replace("i.description", "<[^>]+>", " "), r"\s+", " "))
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("i.pubDate", "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("i.pubDate"))
    return each.select("feed_url", "source_tier", F.trim("i.title").alias("title"), F.trim("i.link").alias("link"), text.alias("summary"), when.alias("published"))
