"""Spelling variants by a relational trie frontier.

Words are paths in two tries, one of the words and one of the words read backwards; a trie is a
table of edges (node, letter, child), and a node is known by a hash of the letters that lead to it.
States (word, position, node, edits) move through that table level by level in joins: without an
edit a state lies on its word's own path, an edit replaces or skips a letter, and after it every
letter has to match. States that end in a word's last node are neighbours with one edit. Edits in a
word's second half are looked for in the first trie and all others in the second, so that a state
leaves its path only deep in a trie, where nodes have few children.

Of one pair the longer word skips a letter, or the word with the smaller letter replaces it, so each
is found once. Levels are depths modulo SPAN: at a multiple of SPAN what is left of a long word is
one edge more, which is matched by its hash, so the number of levels is bounded at any word length.
All pairs are verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.common import CRC_TABLE_SQL, crc_sql, cut, drop_cut, new_folder

SHORTEST = 7
LEAST = 2
FACTOR = 10
SPAN = 32
DROP = 31  # one in so many hashes deletes a letter of a run
HELD_WORDS = 200_000  # counts that a task holds before it hands them on
MODULUS, BASE = (1 << 61) - 1, 0x9E3779B97F4A7C15 % ((1 << 61) - 1)
RUNS = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % SHORTEST)
WORDS = "id long, back long, word string, n long"
EDGES = "level int, node long, letter string, child long"
STATES = "level int, id long, node long, edits int, ahead string, tail long"
TAILS = "node long, tail long, end long"


def runs_of(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """(word, count) of a text, as Latin-1 bytes; all letters of runs are in Latin-1.

    Runs shorter than SHORTEST can't become words, as letters are only deleted."""
    if not text:
        return
    found = Counter(RUNS.findall(text.encode("latin-1", "replace").lower()))
    seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in found.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            yield run, n


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": pa.array(held.values(), pa.int64())})
        held.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run, n in runs_of(doc_id, text):
                held[run] += n
            if len(held) >= HELD_WORDS:
                yield out()
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of words with at least SHORTEST letters and LEAST occurrences."""
    parts = docs.select("doc_id", "text").mapInArrow(count_batches, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def path_of(word: str, start: int) -> list[int]:
    """Node of every prefix; ``start`` tells the two tries apart."""
    path, h = [start], start
    for c in word:
        h = (h * BASE + ord(c) + 1) % MODULUS
        path.append(h)
    return path


def tails_of(word: str) -> list[int]:
    """Hash of every suffix."""
    out, h = [0] * (len(word) + 1), 0
    for i in range(len(word) - 1, -1, -1):
        h = out[i] = (h * BASE + ord(word[i]) + 1) % MODULUS
    return out


def by_rows(make: Callable[[tuple], Iterator[tuple]], schema: str, rows: int = 20_000) -> Callable:
    """mapInArrow function: ``make`` gives tuples for a row; they leave in batches of ``rows``."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for out in make(row):
                    held.append(out)
                    if len(held) >= rows:
                        yield batch_of(held)
                        held.clear()
        if held:
            yield batch_of(held)

    return run


def named(row) -> Iterator[tuple]:
    word, n = row
    yield path_of(word, 1)[-1], path_of(word[::-1], 2)[-1], word, n


def both_ways(word: str) -> Iterator[tuple[str, int, int]]:
    """(letters, root, first position whose edits belong to this trie)."""
    half = len(word) // 2
    yield word, 1, half
    yield word[::-1], 2, len(word) - half


def edges_of(row) -> Iterator[tuple]:
    """Edges of the parts of both paths that a state of this word or one letter longer can walk."""
    for letters, root, _ in both_ways(row[0]):
        path = path_of(letters, root)
        for d in range(len(letters) // 2, len(letters)):
            yield d % SPAN, path[d], letters[d], path[d + 1]


def tail_edges_of(row) -> Iterator[tuple]:
    for letters, root, _ in both_ways(row[0]):
        if len(letters) > SPAN:
            path, tails = path_of(letters, root), tails_of(letters)
            for d in range(SPAN, len(letters), SPAN):
                yield path[d], tails[d], path[-1]


def states_of(row) -> Iterator[tuple]:
    """States of a word before the edit (0, the letter to be replaced comes first) and after a
    skipped letter (1). ``ahead`` holds the letters up to the next multiple of SPAN in the trie,
    ``tail`` the hash of those behind, null where there are none. A letter of a run of equal ones
    is skipped once: the last of the word as it is written, which read backwards is the first."""
    word_id, word = row
    for letters, root, first in both_ways(word):
        size, path = len(letters), path_of(letters, root)
        tails = tails_of(letters) if size > SPAN else None
        for p in range(first, size):
            room = SPAN - p % SPAN
            end = p + room
            yield p % SPAN, word_id, path[p], 0, letters[p:end], tails[end] if end < size else None
            beside = p + 1 if root == 1 else p - 1
            if 0 <= beside < size and letters[beside] == letters[p]:
                continue
            end = p + 1 + room
            yield p % SPAN, word_id, path[p], 1, letters[p + 1 : end], tails[end] if end < size else None


def near_pairs(words: DataFrame) -> DataFrame:
    """(id, end): a word's id and the last node, in either trie, of each word one edit from it; each
    pair from one side. ``words`` has WORDS and is read several times."""
    spark = words.sparkSession
    bare = words.select("word")
    edges = bare.mapInArrow(by_rows(edges_of, EDGES), EDGES).distinct()
    folder = new_folder(spark, "trie")
    edges.write.partitionBy("level").parquet(f"{folder}/edges")
    words.select("id", "word").mapInArrow(by_rows(states_of, STATES), STATES).write.partitionBy("level").parquet(f"{folder}/states")
    schema = "{}, level int"
    edges = spark.read.schema(schema.format(EDGES.split(", ", 1)[1])).parquet(f"{folder}/edges")
    seeds = spark.read.schema(schema.format(STATES.split(", ", 1)[1])).parquet(f"{folder}/states")
    levels = sorted(r["level"] for r in seeds.select("level").distinct().collect())
    columns = ["id", "node", "edits", "ahead", "tail"]
    moved: list[DataFrame] = []
    live = None
    for level in range(levels[0], levels[-1] + 1) if levels else []:
        states = seeds.where(F.col("level") == level).select(*columns)
        if live is not None:
            states = states.unionByName(live)
        here = edges.where(F.col("level") == level).select("node", "letter", "child")
        first = F.substring("ahead", 1, 1)
        match = F.when(F.col("edits") == 0, F.col("letter") > first).otherwise(F.col("letter") == first)
        ahead = F.expr("substring(ahead, 2)").alias("ahead")
        step = states.where("ahead <> ''").join(here, "node").where(match).select("id", F.col("child").alias("node"), F.lit(1).alias("edits"), ahead, "tail")
        moved.append(cut(step, "frontier", "lz4"))
        live = moved[-1].where("ahead <> ''")
    done = [seeds.where("edits = 1").select(*columns), *moved]
    ends = done[0]
    for part in done[1:]:
        ends = ends.unionByName(part)
    ends = ends.where("ahead = ''").select("id", "node", "tail")
    tails = bare.where(F.length("word") > SPAN).mapInArrow(by_rows(tail_edges_of, TAILS), TAILS)
    whole = ends.where("tail IS NULL").select("id", F.col("node").alias("end"))
    return whole.unionByName(ends.where("tail IS NOT NULL").join(tails, ["node", "tail"]).select("id", "end"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words one edit apart. Distances are
    checked on the words, so hashes that meet by chance give nothing."""
    ends = words.select(F.col("id").alias("end"), "word", "n").unionByName(words.select(F.col("back").alias("end"), "word", "n"))
    ends = ends.select("end", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = near_pairs(words).join(ends, "end").join(words.select("id", "word", "n"), "id")
    pairs = met.where(F.levenshtein("word", "near", 1) == 1).select("id", "word", "n", "near", "near_n").dropDuplicates(["id", "near"]).drop("id")
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back)


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: the end of the chain of forms. A form has at least
    FACTOR times its word's occurrences, so chains are short and never close; each round doubles
    the steps."""
    roots = cut(forms.select("word", F.col("form").alias("root")), "form-roots")
    while True:
        steps = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(roots.join(steps, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "form-roots")
        drop_cut(roots)
        roots = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return roots


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``.

    Words are maximal runs of Latin letters, A-Z in lower case, some with a letter deleted by the
    hash of document and run, of at least SHORTEST letters and LEAST occurrences. form is the word
    one edit away with the most occurrences, ties to the smallest in code-point order, where that is
    at least FACTOR times the word's; root follows forms to the last. Null and empty texts have no
    words; a null doc_id hashes as the empty text; repeated rows count each; an empty table gives no
    rows; extra columns are not read. Memory of a task does not grow with a text's words beyond
    the text itself; a word of any length counts.
    """
    counted = cut(word_counts(docs), "words")
    words = cut(counted.mapInArrow(by_rows(named, WORDS), WORDS), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best")
    near = neighbours(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.least") >= F.lit(FACTOR) * F.col("n")
    rated = cut(near.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.least")).alias("form_n")), "variants")
    roots = last_forms(rated.where("form IS NOT NULL"))
    whole = words.select("word", "n").join(rated.drop("n"), "word", "left").join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


VARIANTS_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
    GROUP BY ALL HAVING length(run) >= {SHORTEST}),
hashed AS (
    SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
    SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
        sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {LEAST}),
shorter AS (
    SELECT DISTINCT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS d
    FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS p FROM words)),
pairs AS (
    SELECT s.word, w.word AS near FROM shorter s JOIN words w ON s.d = w.word
    UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.d = w.word
    UNION SELECT a.word, b.word FROM shorter a JOIN shorter b ON a.p = b.p AND a.d = b.d AND a.word <> b.word),
near AS (
    SELECT p.word, a.n, count(*) AS n_near, max(b.n) AS most,
        min(struct_pack(k := -b.n, w := hex(encode(p.near)), near := p.near)).near AS best
    FROM pairs p JOIN words a ON a.word = p.word JOIN words b ON b.word = p.near GROUP BY ALL),
forms AS (SELECT word, best AS form, most AS form_n FROM near WHERE most >= {FACTOR} * n),
chain AS (
    SELECT word, word AS reached FROM words
    UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.reached),
roots AS (SELECT word, reached AS root FROM chain WHERE reached NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, r.root, w.n, coalesce(x.n_near, 0) AS n_near, f.form_n
FROM words w JOIN roots r USING (word) LEFT JOIN near x USING (word) LEFT JOIN forms f USING (word)
"""
