"""Line-first quality rules: failing lines go first, then documents that lost too much.

Per line: terminal punctuation, navigation and boilerplate rules. Per document: the base
measures (word and symbol counts, duplicate lines, repeated eight-word windows) and the
share of text that the failing lines held.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.common import arrow_map, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\r\x0b\x0c"
# A line fails if one of these patterns (the same in both regex dialects in use) holds, or if ENDING doesn't.
ENDING = r"""[.!?:;…]["'”’)\]»]*$"""
NAVIGATION = r"(^|[ \t])(\||»|›|>>|•|→)([ \t].*[ \t](\||»|›|>>|•|→)([ \t]|$)|$)"
BOILERPLATE = (
    r"(?i)(lorem ipsum|javascript|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|"
    r"sign up|log ?in to|subscribe (now|to)|share this|licensed under|©|\{|\}|</?[a-z]+>)"
)
NAVIGATION_RE, BOILERPLATE_RE = re.compile(NAVIGATION), re.compile(BOILERPLATE)
ENDING_RE = re.compile(ENDING.replace("$", r"\Z"))

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_chars long, cleaned string"
)


def line_passes(line: str) -> bool:
    """``line`` has no white space around it and at least one word."""
    return bool(ENDING_RE.search(line)) and not NAVIGATION_RE.search(line) and not BOILERPLATE_RE.search(line)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that stand at two places or more of the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    h = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        key = key * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[place] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, cleaned)."""
    words = words_of(text)
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in GAPS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    full = [line for line in lines if line.strip(GAPS)]
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    lost, left = 0, []
    for line in lines:
        bare = line.strip(GAPS)
        if bare and not line_passes(bare):
            lost += len(bare)
        else:
            left.append(line)
    total = sum(len(line.strip(GAPS)) for line in full)
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * total
    return n, word_chars, symbols, len(full) - len(set(full)), repeats, failed, kept, lost, "\n".join(left)


def rate_documents(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars[, cleaned]).

    One row per row of ``docs``, from the whole text, in one pass without a shuffle. Null
    text counts as empty: no words, so it fails. ``cleaned`` is the text without failing
    lines (lines without a word stay as they are). Repeated rows are rated alike. Extra
    columns are not read.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t or "") for t in batch.column("text").to_pylist()]
            columns = [list(c) for c in zip(*rows, strict=True)]
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, *([pa.array(columns[8], pa.string())] * with_text)], names=names)

        return work

    schema = SCHEMA if with_text else SCHEMA.rpartition(",")[0]
    names = [c.split()[0] for c in schema.split(", ")]
    return arrow_map(docs.select("doc_id", "text"), make, schema, rows=512)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with failing lines removed; same columns as ``docs``.

    Columns other than text and n_chars pass through unchanged; n_chars, where there is
    one, becomes the length of the cleaned text."""
    text_at = docs.columns.index("text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t or "") for t in batch.column(text_at).to_pylist()]
            keep = pa.array([r[6] for r in rows], pa.bool_())
            cleaned = pa.array([r[8] for r in rows], pa.string())
            out = batch.set_column(text_at, batch.schema.field(text_at).with_type(pa.string()), cleaned)
            return out.filter(keep)

        return work

    kept = arrow_map(docs, make, docs.schema, rows=512)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def duck_re(pattern: str) -> str:
    return pattern.replace("'", "''")


# The same rows as SQL. Lines are stripped of the six white space characters before the rules.
RATE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
grams AS (
  SELECT r, i, {" || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i)" for k in range(1, WINDOW)])} AS g
  FROM tokens
),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams WHERE g IS NOT NULL) WHERE c > 1
),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY r
),
lines AS (
  SELECT r, l, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs)
),
by_line AS (
  SELECT r, count(*) - count(DISTINCT l) AS dup, sum(length(b)) AS total,
         sum(CASE WHEN regexp_matches(b, '{duck_re(ENDING)}') AND NOT regexp_matches(b, '{duck_re(NAVIGATION)}')
                   AND NOT regexp_matches(b, '{duck_re(BOILERPLATE)}') THEN 0 ELSE length(b) END) AS lost
  FROM lines WHERE b <> '' GROUP BY r
),
base AS (
  SELECT d.r, d.doc_id, len(w) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total
  FROM docs d JOIN words USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN by_line b USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * lost <= {MAX_LOST_PERCENT} * total AS kept,
       CAST(lost AS BIGINT) AS lost_chars
FROM base
"""
