"""Category families, search texts and windows."""

import pytest
from pyspark.sql import functions as F

from tapeglass.functions import taxonomy

DAY = taxonomy.DAY_US


def test_families(spark):
    rows = [
        ("Sports_Prop", None, None, None, "sports_prop", "sports"), ("macro", "KXNBA-1", "x", None, "sports_outcome", "sports"), ("macro", " ", "kxufc-3", None, "sports_outcome", "sports"),
        ("macro", "X", "KXNBA", None, "macro", "macro"), (None, None, None, "Lions vs. Bears", "sports_outcome", "sports"), (None, None, None, "advise", None, "unclassified"), ("", None, None, " ", None, "unclassified"),
        ("weather", None, "KXRAIN", "Rain in the city", "sports_outcome", "sports"), ("weather", None, "KXRAIN", "Will it rain?", "weather", "weather"),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i long, c string, e string, m string, t string")
    normal = taxonomy.normal_category(F.col("c"), F.col("e"), F.col("m"), F.col("t"))
    got = df.select("i", normal.alias("n")).select("i", "n", taxonomy.category_family(F.col("n")).alias("f")).orderBy("i").collect()
    assert [(r.n, r.f) for r in got] == [r[4:] for r in rows]


def test_search_texts(spark):
    rows = [
        ("Will the Fed cut rates in May??", None, "m", "Fed cut rates May"), ("Fed's $5 cut", "at 3.5 by Q2", "m", "(Fed cut) OR (3.5 Q2)"), ("Same thing", "Same thing", "m", "Same thing"),
        (None, "only sub", "m", "only sub"), ("  ", "", " m ", "m"), (None, None, None, ""), ("a b c d", None, "m", "m"), ("one two three four five six seven eight nine", None, "m", "one two three four five six seven eight"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i long, t string, s string, m string")
    got = df.select("i", taxonomy.search_text(F.col("t"), F.col("s"), F.col("m")).alias("q")).orderBy("i").collect()
    assert [r.q for r in got] == [r[3] for r in rows]


@pytest.mark.parametrize("opened,closed,trade,flag,want", [
    (None, None, None, None, (70, 100, "default")), (None, 90, None, None, (60, 90, "default")), (None, None, 50, 40, (43, 50.5, "activity")), (None, None, 50, 60, (53, 60.5, "activity")),
    (48, None, 50, None, (48, 50.5, "activity")), (None, 50, 50, None, (43, 50, "activity")), (60, 50, 50, None, (20, 50, "default")), (None, None, 99.9, None, (92.9, 100, "activity")), (None, 10, 50, None, (-20, 10, "default")),
])
def test_windows(spark, opened, closed, trade, flag, want):
    us = lambda x: F.lit(None if x is None else int(x * DAY)).cast("long")
    w = spark.range(1).select(taxonomy.news_window(us(opened), us(closed), us(trade), us(flag), 100 * DAY).alias("w")).first().w
    assert (w.start_us / DAY, w.end_us / DAY, w.align) == pytest.approx(want)
