"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line's shingles are the SHINGLE characters from each of its characters on (a shorter line is
one shingle). Characters are UTF-16 units, so a character outside the basic plane counts as two.
One hash per shingle gives minima in BINS ranges of the hash space; band j reads ROWS minima in a
row from its own point of that circle, so lines with few shingles have full bands too. Lines that
share a band are compared with the band's pivot by exact Jaccard, and links are joined by
star contraction. A band's pivot is the line whose bands are the largest, which of many near copies
is the one with the least changes, so most links of the others need not be found one by one; lines
outside its component are compared with a second pivot. In bands that still hold several components,
every link that is left is found: bands of at most BLOCK lines compare all their lines by bit sets,
which never lose a link, and lines of larger ones meet in an exact set join by prefixes. The first
line of each component stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeglass.llm.common import cut, drop_cut, free_shuffles, shuffle_count
from tapeglass.llm.components import bit_filter, connected_components, passes_bits

SHINGLE = 12
ROWS = 3
BANDS = 8
BINS = ROWS * BANDS
MIN_WORDS = 3
REACH = 6  # a bin's minimum is looked for where that many hashes of the bin are expected
BLOCK = 256  # bands up to that many lines are compared line by line
BIT_WORDS = 16  # longs in a line's bit set
ROUNDING = 1e-6  # keeps bounds from rising by the rounding of doubles
NO_SPACES = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"  # scripts written without spaces


def normal(line: Column) -> Column:
    """Lower case, no white space at the ends, runs of spaces and tabs as one space, and spaces
    around each character of a script without them."""
    wide = F.octet_length(line) >= 2 * F.length(line)
    spread = F.when(wide, F.regexp_replace(line, f"([{NO_SPACES}])", " $1 ")).otherwise(line)
    odd = wide | F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t"))
    return F.lower(F.btrim(F.when(odd, F.regexp_replace(spread, r"[ \t]+", " ")).otherwise(line), F.lit(" \t\r\f\x0b")))


def long_enough(norm: Column) -> Column:
    """At least MIN_WORDS words."""
    return F.substring_index(norm, " ", MIN_WORDS) != F.substring_index(norm, " ", MIN_WORDS - 1)


def shingle_hashes(norm: Column) -> Column:
    """Hashes of the SHINGLE characters from each character on. The bytes are bound to a lambda
    variable once, as a column would be copied for each shingle."""
    width = 2 * SHINGLE
    starts = lambda b: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(b) - F.lit(width - 1)), F.lit(2))
    hashes = F.transform(F.array(F.encode(norm, "UTF-16BE")), lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substr(b, i, F.lit(width)))))
    return F.get(hashes, F.lit(0))


def shingle_set(norm: Column) -> Column:
    """The distinct ones of :func:`shingle_hashes`."""
    return F.array_distinct(shingle_hashes(norm))


def split_lines(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, line_no, norm): every line with its normal form. row_id is a hash of
    doc_id and text, so repeated rows count as one document."""
    row_id = F.xxhash64("doc_id", F.octet_length("text"), "text").alias("row_id")
    whole = docs.where("text IS NOT NULL").select(row_id, "doc_id", F.split("text", "\n").alias("lines"))
    # outer: else Spark adds a filter on the size of the lines, which splits every text twice
    lines = whole.select("row_id", "doc_id", F.posexplode_outer("lines").alias("line_no", "line"))
    return lines.select("row_id", "doc_id", "line_no", normal(F.col("line")).alias("norm"))


def signatures(lines: DataFrame) -> DataFrame:
    """(line_id, filled, c0..): minima of the non-empty bins in bin order, for each distinct
    line, and how many of them lie before each band's point.

    Shingles leave the generator inside generated code and are aggregated in two steps, by line
    and band, then by line, both without a further shuffle. Of a line with n > 2 * REACH * BINS
    shingles, hashes above a bound set by the octave of n are left out first: at least REACH of
    a bin's hashes are expected below it, so with a chance under exp(-REACH) a bin counts as
    empty. That only moves which lines meet; links are verified on whole sets."""
    width = 2 * SHINGLE
    coded = lines.dropDuplicates(["line_id"]).select("line_id", F.encode("norm", "UTF-16BE").alias("b"))
    octave = f"length(bin(greatest(1, octet_length(b) div 2 - {SHINGLE - 1}))) - 1"
    bound = F.expr(f"shiftright({REACH * BINS}L * 8589934592L, {octave})").alias("bound")
    # the condition, always true, holds the filter on hashes behind them: pushed below, it would make each hash a second time
    once = F.when(F.spark_partition_id() >= 0, F.expr(f"xxhash64(substring(b, i, {width}))"))
    hashed = coded.select("line_id", "b", bound).select(
        "line_id", "bound", "b", F.explode(F.expr(f"sequence(1, greatest(1, octet_length(b) - {width - 1}), 2)")).alias("i")
    ).select("line_id", "bound", once.alias("h"))
    part = F.expr(f"int(shiftrightunsigned(shiftrightunsigned(h, 33) * {BANDS}L, 31))").alias("part")
    binned = hashed.select("line_id", "bound", part, F.expr(f"(h & 8589934591L) * {ROWS}L").alias("g"))
    low = binned.where("(g & 8589934591L) < bound").select("line_id", "part", F.expr("int(shiftrightunsigned(g, 33))").alias("r"), F.expr("g & 8589934591L").alias("v"))
    parts = low.groupBy("line_id", "part").agg(*[F.min(F.when(F.col("r") == k, F.col("v"))).alias(f"p{k}") for k in range(ROWS)])
    minima = parts.groupBy("line_id").agg(
        *[F.min(F.when(F.col("part") == i // ROWS, F.col(f"p{i % ROWS}"))).alias(f"m{i}") for i in range(BINS)]
    )
    before: list[Column] = [F.lit(0)]
    for j in range(1, BANDS):
        before.append(sum((F.col(f"m{i}").isNotNull().cast("int") for i in range(ROWS * j)), F.lit(0)))
    filled = F.array_compact(F.array(*[F.col(f"m{i}") + F.lit(i << 33) for i in range(BINS)]))
    return minima.select("line_id", filled.alias("filled"), *[c.alias(f"c{j}") for j, c in enumerate(before)])


def bands(signed: DataFrame) -> DataFrame:
    """(band, line_id): one key per band of every distinct line."""
    ring = signed.withColumn("ring", F.concat("filled", F.slice("filled", 1, ROWS)))
    keys = [F.xxhash64(F.lit(j), F.slice("ring", F.col(f"c{j}") + 1, ROWS)) for j in range(BANDS)]
    return ring.select("line_id", F.explode(F.array(*keys)).alias("band"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of line ids whose shingle sets, of n and m hashes, reach ``similarity``. Hashes
    are made from the texts after the joins, as they are many times larger."""
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("norm").alias("na")), "a").join(
        texts.select(F.col("line_id").alias("b"), F.col("norm").alias("nb")), "b"
    )
    parts = shuffle_count(pairs.sparkSession)
    hashed = both.repartition(parts, "a", "b").select("a", "b", "n", "m", shingle_hashes(F.col("na")).alias("ha"), shingle_hashes(F.col("nb")).alias("hb"))
    share = F.lit(similarity)
    common = F.size(F.array_intersect("ha", "hb"))  # distinct ones
    return hashed.where(common * (1 + share) >= share * (F.col("n") + F.col("m"))).select("a", "b")


def rooted_lines(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, line_id, root); a line without links is its own root."""
    return shared.join(roots.withColumnRenamed("node", "line_id"), "line_id", "left").select("band", "line_id", F.coalesce("root", "line_id").alias("root"))


def pivot_pairs(rows: DataFrame, among: DataFrame) -> DataFrame:
    """(a, b): each band's pivot, the heaviest of its lines in ``among``, with the band's lines of other
    components. Both have band, line_id, root and weight. Copies that keep all minima weigh as much as
    their line; a hash chooses among them, so that bands have different pivots then."""
    pivots = among.groupBy("band").agg(F.max(F.struct("weight", F.xxhash64("band", "line_id"), "line_id", "root")).alias("p"))
    met = rows.join(pivots, "band").where("root <> p.root")
    return met.select(F.col("p.line_id").alias("a"), F.col("line_id").alias("b")).distinct()


def outer_pairs(weighed: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs as in :func:`pivot_pairs` for bands that still hold several components, with pivots
    from outside the component of the first one. ``weighed`` has band, line_id and weight."""
    rooted = weighed.join(roots.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))
    first = rooted.groupBy("band").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("lines"), F.max(F.struct("weight", F.xxhash64("band", "line_id"), "line_id", "root")).alias("p")
    )
    rows = cut(rooted.join(first.where("x < y AND lines > 2").select("band", F.col("p.root").alias("inner")), "band"), "line-outer")
    return pivot_pairs(rows, rows.where("root <> inner"))


def bit_sets(texts: DataFrame) -> DataFrame:
    """(line_id, n, b0..): for each line the number of its distinct shingles and, for each of the bits
    their hashes are dealt to, whether an odd number of them is there."""
    sets = texts.select("line_id", shingle_set(F.col("norm")).alias("set")).select("line_id", F.size("set").alias("n"), "set")
    hashed = sets.select("line_id", "n", F.explode_outer("set").alias("h"))  # outer: else a filter makes every set twice
    bits = [F.expr(f"bit_xor(if(pmod(shiftright(h, 6), {BIT_WORDS}) = {k}, shiftleft(1L, int(h & 63L)), 0L))").alias(f"b{k}") for k in range(BIT_WORDS)]
    return hashed.groupBy("line_id", "n").agg(*bits)


def other_bits(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of :func:`bit_sets` under the names of a pair's second line."""
    names = {"line_id": "b", "n": "m", **{f"b{k}": f"o{k}" for k in range(BIT_WORDS)}}
    return rows.withColumnsRenamed(names)


def near_bits(similarity: float) -> Column:
    """Whether two lines may reach ``similarity``; true for all that do.

    A shingle that both lines have changes the same bit of both, so a bit that differs stands for a
    shingle that only one of them has, however full the bits are; and sets of n and m shingles that
    reach the similarity s differ in at most (n + m) * (1 - s) / (1 + s)."""
    apart = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"o{k}"))) for k in range(BIT_WORDS)), F.lit(0))
    return apart * F.lit(1 + similarity) <= (F.col("n") + F.col("m")) * F.lit(1 - similarity) + ROUNDING


def near_pairs(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) that pass :func:`near_bits`, with the sizes n and m of their sets."""
    both = pairs.join(known.withColumnRenamed("line_id", "a"), "a").join(other_bits(known), "b")
    return both.where(near_bits(similarity)).select("a", "b", "n", "m")


def pairs_of_blocks(rows: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n, m): pairs of different components in one band that pass :func:`near_bits`. That is decided
    inside the join, so only what passes becomes a row."""
    one = cut(rows.join(known, "line_id"), "line-blocks")
    two = other_bits(one.withColumnRenamed("root", "b_root"))
    met = one.join(two, "band").where((F.col("line_id") < F.col("b")) & (F.col("root") != F.col("b_root")) & near_bits(similarity))
    return met.select(F.col("line_id").alias("a"), "b", "n", "m").distinct()


def pairs_by_prefixes(lines: DataFrame, texts: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n, m): pairs of different components of ``lines`` (line_id, root) that may reach ``similarity``;
    every pair that does is among them.

    An exact set join by prefixes: the shingles of these lines are ordered from rare to frequent, in
    one order for all. Two sets of n and m shingles that reach ``similarity`` have one of their first
    n - ceil(similarity * n) + 1 and m - ceil(similarity * m) + 1 in common, and behind their first
    common one enough are left in both for the overlap that is needed. That and :func:`near_bits`, with
    the bit sets ``known`` of the lines, are decided inside the join. So lines that share a passage, whose
    shingles are frequent, do not meet by it, and the pairs grow with the links and not with the bands."""
    sets = texts.join(lines, "line_id").select("line_id", "root", shingle_set(F.col("norm")).alias("set"))
    shingles = sets.select("line_id", "root", F.size("set").alias("n"), F.explode_outer("set").alias("h"))
    met = shingles.groupBy("h").agg(F.count("*").alias("f"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h", "f")
    # shingles of one component come first in the order: no pair of two components shares them
    line = Window.partitionBy("line_id")
    alone = F.col("n") - F.count("*").over(line)
    ranked = shingles.join(met, "h").withColumn("at", alone + F.row_number().over(line.orderBy("f", "h")))
    share = F.lit(similarity)
    prefix = F.col("n") - F.ceil(share * F.col("n") - ROUNDING) + 1
    # a line meets its bits once, not for each shingle
    prefixes = ranked.where(F.col("at") <= prefix).groupBy("line_id", "root", "n").agg(F.collect_list(F.struct("h", "at")).alias("prefix"))
    first = cut(prefixes.join(known.drop("n"), "line_id").select("*", F.inline("prefix")).drop("prefix"), "line-prefixes")
    two = other_bits(first.withColumnsRenamed({"root": "b_root", "at": "b_at"}))
    rest = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("b_at"))
    reach = (1 + rest) * (1 + share) >= share * (F.col("n") + F.col("m")) - ROUNDING
    pairs = first.join(two, "h").where((F.col("line_id") < F.col("b")) & (F.col("root") != F.col("b_root")) & reach & near_bits(similarity))
    return pairs.select(F.col("line_id").alias("a"), "b", "n", "m").distinct()


def links_inside_bands(
    shared: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK, known: DataFrame | None = None
) -> DataFrame:
    """(a, b): every link of different components between lines that share a band. Bands of one
    component need nothing; of the others, those of at most ``block`` lines are compared line by line
    and the rest by prefixes. What both let through is verified on whole sets. ``known`` holds the bit
    sets of ``texts`` where they are made already."""
    rooted = rooted_lines(shared, roots)
    several = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("lines")).where("x < y AND lines > 2")
    rows = cut(rooted.join(several.select("band", "lines"), "band"), "line-open")
    known = bit_sets(texts) if known is None else known
    pairs = pairs_of_blocks(rows.where(F.col("lines") <= block).drop("lines"), known, similarity)
    large = rows.where(F.col("lines") > block).select("line_id", "root").distinct()
    if not large.isEmpty():
        more = pairs_by_prefixes(cut(large, "line-open"), texts, known, similarity)
        pairs = pairs.unionByName(more).distinct()
    return verified(pairs, texts, similarity)


def as_links(roots: DataFrame) -> DataFrame:
    """(a, b): every node with its root."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def line_roots(lines: DataFrame, similarity: float) -> DataFrame:
    """(node, root) over the ids of lines that have links: lines that share a band and whose
    exact Jaccard reaches ``similarity``."""
    banded = cut(bands(signatures(lines)), "line-bands")
    free_shuffles(lines.sparkSession)  # the texts, before the bands are shuffled
    together = banded.withColumn("lines", F.count("*").over(Window.partitionBy("band")))
    shared = cut(together.where("lines > 1"), "line-shared")
    drop_cut(banded)
    free_shuffles(lines.sparkSession)
    wanted = shared.select("line_id").distinct()
    texts = cut(
        passes_bits(lines.select("line_id", "norm"), "line_id", bit_filter(wanted, "line_id"))
        .dropDuplicates(["line_id"])
        .join(wanted, "line_id", "left_semi"),
        "line-texts",
    )
    weight = F.sum("lines").over(Window.partitionBy("line_id"))
    weighed = cut(shared.select("band", "line_id", weight.alias("weight")), "line-weights")
    drop_cut(shared)
    known = cut(bit_sets(texts), "line-bits")
    alone = weighed.withColumn("root", F.col("line_id"))
    roots = cut(connected_components(verified(near_pairs(pivot_pairs(alone, alone), known, similarity), texts, similarity)), "line-components")
    outer = cut(verified(near_pairs(outer_pairs(weighed, roots), known, similarity), texts, similarity), "line-outer")
    if not outer.isEmpty():
        roots = cut(connected_components(as_links(roots).unionByName(outer)), "line-components")
    more = cut(links_inside_bands(weighed.select("band", "line_id"), roots, texts, similarity, known=known), "line-more")
    drop_cut(weighed)
    drop_cut(texts)
    drop_cut(known)
    if more.isEmpty():
        return roots
    return connected_components(as_links(roots).unionByName(more))


def mark_lines(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """(row_id, doc_id, line_no, component_id, kept) for every line of every document.

    component_id is the smallest line id among the lines linked to this one; kept is false
    for every line of a component but the one with the smallest (doc_id, row_id, line_no),
    a null doc_id counting as the smallest. Lines of fewer than MIN_WORDS words are always
    kept, as their own component, with a null id. Null text has no lines; empty text has
    one empty line. Repeated rows (same doc_id and text) keep the same lines. An empty
    table gives no rows; extra columns are not read. The chance that two different lines
    get one 64-bit id is under 1e-6 for a billion distinct lines and grows with the square.
    """
    line_id = F.when(long_enough(F.col("norm")), F.xxhash64("norm"))
    places = cut(split_lines(docs).withColumn("line_id", line_id), "line-places")
    found = line_roots(places.where("line_id IS NOT NULL").select("line_id", "norm"), similarity)
    roots = found.where("node <> root").withColumnRenamed("node", "line_id")
    rooted = places.join(roots, "line_id", "left").select(
        "row_id", "doc_id", "line_no", F.coalesce("root", "line_id").alias("component_id")
    )
    rooted = cut(rooted, "line-roots")
    place = F.struct("doc_id", "row_id", "line_no")
    repeated = (
        rooted.where("component_id IS NOT NULL")
        .groupBy("component_id")
        .agg(F.count("*").alias("n"), F.min(place).alias("keeper"))
        .where("n > 1")
        .select("component_id", "keeper")
    )
    kept = F.col("keeper").isNull() | (F.col("keeper") == place)
    return rooted.join(repeated, "component_id", "left").select("row_id", "doc_id", "line_no", "component_id", kept.alias("kept"))


def dedup_lines(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """``docs`` without the lines that :func:`mark_lines` drops; same columns.

    A document that had lines with words and lost them all is dropped; n_chars, where there
    is one, follows the text. Other columns pass through."""
    marked = mark_lines(docs, similarity)
    gone = cut(marked.where("NOT kept").select("row_id", "line_no").distinct(), "line-gone")
    by_row = gone.groupBy("row_id").agg(F.collect_set("line_no").alias("gone_lines"))
    keyed = docs.select(F.xxhash64("doc_id", F.octet_length("text"), "text").alias("row_id"), F.struct("*").alias("doc"))
    joined = keyed.join(by_row, "row_id", "left")
    old = F.col("doc")["text"]
    left = F.array_join(F.filter(F.split(old, "\n"), lambda line, i: ~F.array_contains(F.col("gone_lines"), i)), "\n")
    text = F.when(F.col("gone_lines").isNull(), old).otherwise(left)
    new = joined.select("doc", text.alias("new_text"), F.col("gone_lines").isNull().alias("whole"))
    new = new.where(F.col("whole") | F.col("new_text").rlike(r"[^ \t\n\r\x0B\f]"))
    fresh = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return new.select(*[fresh.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
