"""Public events behind news articles: clusters of articles that share enough words within a day.

Two articles are similar by the largest of Jaccard, 0.75 * containment and 0.42 from five shared
words on, and linked from 0.42 on if at most 24 hours lie between them. For sets of n and m words
that is: at least needed(min(n, m)) shared words. Words are ordered from rare to frequent, so two
such sets share one of their first n - needed + 1 words, and frequent words never bring articles
together, but for sets of less than eight words.

Articles with the same words on the same day are one unit, so copies meet once; units are compared
within a day and with the day before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.operators.graph import component_roots
from tapeglass.operators.news import cluster_tokens
from tapeglass.sources.storage import Scratch

# Fixed values.
LEAST_SIMILARITY = 0.42
CONTAINMENT_WEIGHT = 0.75
SHARED_WORDS = 5
DAY_US = 86_400_000_000
FINGERPRINT_WORDS = 32
MOST_CHARS = 500
MOST_DOMAINS = 10


def similarity(shared: Column, n: Column, m: Column) -> Column:
    """Similarity of two word sets of n and m words of which ``shared`` are common."""
    jaccard = shared / F.greatest(n + m - shared, F.lit(1))
    bonus = F.when(shared >= SHARED_WORDS, LEAST_SIMILARITY).otherwise(0.0)
    return F.when(shared == 0, 0.0).otherwise(F.greatest(jaccard, CONTAINMENT_WEIGHT * shared / F.least(n, m), bonus))


def needed(n: Column) -> Column:
    """Shared words that link two sets of which the smaller has n words: five, or for small sets those
    that make 0.75 * containment 0.42. A Jaccard of 0.42 takes at least as many."""
    return F.least(F.lit(SHARED_WORDS), F.ceil(n * (LEAST_SIMILARITY / CONTAINMENT_WEIGHT) - 1e-9).cast("int"))


def article_units(articles: DataFrame) -> DataFrame:
    """(unit, set_id, day, lo, hi, n, tokens) of ``articles`` (article_id, title, summary, first_seen_us):
    the articles of one day with the same words, by their smallest id. day is null without a time;
    articles without words are no units."""
    text = F.concat_ws(" ", "title", "summary")
    keyed = articles.select("article_id", "first_seen_us", F.array_sort(cluster_tokens(text)).alias("tokens")).where(F.size("tokens") > 0)
    day = F.floor(F.col("first_seen_us") / DAY_US).cast("long").alias("day")
    units = keyed.groupBy(F.xxhash64("tokens").alias("set_id"), day).agg(
        F.min("article_id").alias("unit"), F.min("first_seen_us").alias("lo"), F.max("first_seen_us").alias("hi"), F.first("tokens").alias("tokens")
    )
    return units.select("unit", "set_id", "day", "lo", "hi", F.size("tokens").alias("n"), "tokens")


def postings(units: DataFrame) -> DataFrame:
    """(token, unit, set_id, day, lo, hi, n, need, early): a row for each word of a unit; early tells
    whether it is among those that sets of at least this size have to share."""
    each = units.select("unit", "set_id", "day", "lo", "hi", "n", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy("df", "token"))
    need = needed(F.col("n"))
    return each.join(counts, "token").select("token", "unit", "set_id", "day", "lo", "hi", "n", need.alias("need"), (place <= F.col("n") - need + 1).alias("early"))


def met(posted: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of units of different words that share one they have to share, and whose times allow
    a link; with ``roots`` (node, root) only pairs of different components.

    A unit meets those of its day and the day before by (word, day); units without a time meet all.
    Late words of a unit are only held against early ones of units that need fewer."""
    rows = posted.withColumn("root", F.col("unit"))
    if roots is not None:
        rows = posted.join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    early, late = rows.where("early"), rows.where("NOT early")
    small = early.where(F.col("need") < SHARED_WORDS)
    near = F.greatest(F.col("lo") - F.col("o_hi"), F.col("o_lo") - F.col("hi")) <= DAY_US
    apart = (F.col("set_id") != F.col("o_set_id")) & (F.col("root") != F.col("o_root"))
    fewer = F.col("need") < F.col("o_need")

    def other(right: DataFrame) -> DataFrame:
        return right.withColumnsRenamed({c: f"o_{c}" for c in right.columns})

    def timed(left: DataFrame, right: DataFrame, days: list[int], rule: Column) -> DataFrame:
        slots = other(right.where("day IS NOT NULL")).withColumn("slot", F.explode(F.array(*[F.col("o_day") + d for d in days])))
        return left.join(slots, (F.col("token") == F.col("o_token")) & (F.col("day") == F.col("slot")) & near & apart & rule).select("unit", "o_unit")

    def timeless(left: DataFrame, right: DataFrame, rule: Column) -> DataFrame:
        one = left.join(other(right.where("day IS NULL")), (F.col("token") == F.col("o_token")) & apart & rule)
        two = left.where("day IS NULL").join(other(right.where("day IS NOT NULL")), (F.col("token") == F.col("o_token")) & apart & rule)
        return one.select("unit", "o_unit").unionByName(two.select("unit", "o_unit"))

    once = (F.col("day") > F.col("o_day")) | (F.col("unit") < F.col("o_unit"))
    pairs = timed(early, early, [0, 1], once).unionByName(timed(small, late, [-1, 0, 1], fewer))
    pairs = pairs.unionByName(timeless(early, early, F.lit(True))).unionByName(timeless(small, late, fewer))
    return pairs.select(F.least("unit", "o_unit").alias("a"), F.greatest("unit", "o_unit").alias("b")).distinct()


def measured(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with shared words and similarity, those that are linked."""
    one = units.select(F.col("unit").alias("a"), F.col("tokens").alias("ta"))
    two = units.select(F.col("unit").alias("b"), F.col("tokens").alias("tb"))
    sized = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), F.size("ta").alias("n"), F.size("tb").alias("m"))
    return sized.withColumn("similarity", similarity(F.col("shared"), F.col("n"), F.col("m"))).where(F.col("similarity") >= LEAST_SIMILARITY).drop("n", "m")


def article_pairs(articles: DataFrame) -> DataFrame:
    """(a, b, shared, similarity) of all linked units, a unit being named by its smallest article: the
    similar articles with different words, copies of a day standing as one."""
    units = article_units(articles)
    return measured(met(postings(units)), units)


def copies_over_days(units: DataFrame) -> DataFrame:
    """(a, b): units of the same words on neighbouring days within 24 hours, or one without a time."""
    keep = units.select("unit", "set_id", "day", "lo", "hi")
    later = keep.withColumnsRenamed({c: f"o_{c}" for c in keep.columns})
    days = keep.join(later, (F.col("set_id") == F.col("o_set_id")) & (F.col("day") + 1 == F.col("o_day")) & (F.col("o_lo") - F.col("hi") <= DAY_US))
    timeless = keep.join(later.where("o_day IS NULL"), (F.col("set_id") == F.col("o_set_id")) & F.col("day").isNotNull())
    return days.select("unit", "o_unit").unionByName(timeless.select("unit", "o_unit")).toDF("a", "b")


def unit_roots(units: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) of units that are linked to others.

    First each unit is held against the smallest that shares an early word and the day, which joins
    most of a large group in linear work; only units of components that are still apart then meet."""
    posted = work.settle(postings(units))
    early = posted.where("early")
    hubs = early.groupBy("token", "day").agg(F.min("unit").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k")
    spokes = early.join(hubs, ["token", "day"]).where("a < unit").select("a", F.col("unit").alias("b")).distinct()
    first = work.settle(measured(spokes, units).select("a", "b").unionByName(copies_over_days(units)))
    roots = component_roots(first)
    rest = work.settle(measured(met(posted, roots), units).select("a", "b"))
    work.free(posted)
    return component_roots(first.unionByName(rest))


def clustered_articles(articles: DataFrame) -> DataFrame:
    """``articles`` with cluster_id, the smallest article of their event. Articles without words are
    events of their own."""
    work = Scratch(articles.sparkSession)
    units = work.settle(article_units(articles))
    roots = unit_roots(units, work)
    rooted = units.select("set_id", F.coalesce("day", F.lit(-1 << 40)).alias("day"), "unit").join(roots.withColumnRenamed("node", "unit"), "unit", "left")
    found = rooted.select("set_id", "day", F.coalesce("root", "unit").alias("cluster_id"))
    text = F.concat_ws(" ", "title", "summary")
    day = F.coalesce(F.floor(F.col("first_seen_us") / DAY_US).cast("long"), F.lit(-1 << 40))
    keyed = articles.select(F.struct(*articles.columns).alias("article"), F.array_sort(cluster_tokens(text)).alias("tokens"), day.alias("day"))
    keyed = keyed.withColumn("set_id", F.when(F.size("tokens") > 0, F.xxhash64("tokens")))
    joined = keyed.join(found, ["set_id", "day"], "left")
    return joined.select("article.*", "tokens", F.coalesce("cluster_id", F.col("article")["article_id"]).alias("cluster_id"))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)), "^www[.]", ""), F.lit(""))


def article_clusters(clustered: DataFrame) -> DataFrame:
    """One row per event of ``clustered`` (article_id, url, title, summary, first_seen_us, tokens,
    cluster_id): its articles, sources and times, the article to be linked in its place (with a
    summary first, then the longest up to MOST_CHARS, then the largest url), its title, up to
    MOST_DOMAINS sources in order, and a fingerprint of its first FINGERPRINT_WORDS words.

    Words and sources of an event are made distinct before they are ranked, so a large event is
    never gathered in one row."""
    chars = F.least(F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("summary", F.lit(""))), F.lit(MOST_CHARS))
    clear = F.struct((F.length(F.coalesce("summary", F.lit(""))) > 0).alias("told"), chars.alias("chars"), F.coalesce("url", F.lit("")).alias("url"))
    hosted = clustered.withColumn("host", host_of(F.col("url")))
    sums = hosted.groupBy("cluster_id").agg(
        F.count("*").alias("articles"), F.count_distinct("host").alias("sources"), F.min("first_seen_us").alias("first_us"), F.max("first_seen_us").alias("last_us"),
        F.max_by("article_id", clear).alias("representative_id"), F.max_by("url", clear).alias("representative_url"), F.max_by("title", clear).alias("title"),
    )

    def first_of(rows: DataFrame, most: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("x"))
        kept = rows.distinct().withColumn("place", place).where(F.col("place") <= most)
        return kept.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias(name))

    words = first_of(clustered.select("cluster_id", F.explode("tokens").alias("x")), FINGERPRINT_WORDS, "words")
    domains = first_of(hosted.where("host IS NOT NULL").select("cluster_id", F.col("host").alias("x")), MOST_DOMAINS, "domains")
    joined = sums.join(words, "cluster_id", "left").join(domains, "cluster_id", "left")
    fingerprint = F.sha2(F.coalesce("words", "representative_url", F.lit("")), 256).alias("fingerprint")
    return joined.select("cluster_id", "articles", "sources", "first_us", "last_us", "representative_id", "representative_url", "title", "domains", fingerprint)
