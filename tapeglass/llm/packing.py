"""Packing by concatenate-and-cut.

Pass one tokenises every partition once and stores ids with offsets inside the partition.
The partition totals' prefix sums (one number per partition) then give each document its
place in the one long stream of ids, and pass two cuts the stream into windows of the
sequence length; a document that crosses a window's end leaves a boundary record in both
windows. Nothing but the totals is shuffled.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import accumulate
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeglass.llm.common import WordCache, arrow_map, cut, tokenizer_path, words_of

END_ID = 1
# Letters, digits and marks as the tokenizer's own pattern splits them.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Words whose normal form is plain lower case: printable ASCII and precomposed Latin letters.
PLAIN = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable bytes of
    Latin-1 stand for themselves, the others take code points from 256 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordTokens:
    """Ids of a word by the tokenizers library, as packed unsigned 16-bit integers.

    The normaliser and the pre-tokenizer never join what white space parts, so a text's
    ids are its words' ids in a row. A word of plain characters falls further into the
    pattern's matches, which repeat far more often than words do and go straight to the
    library's model; any other word goes through the library whole."""

    def __init__(self, path: str) -> None:
        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.model = self.tok.model
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.parts = WordCache(self.part, limit=800_000)
        self.words = WordCache(self.word, limit=1_200_000)

    def part(self, text: str) -> bytes:
        shown = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        return pack("<%dH" % len(ids), *ids)

    def word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        if PLAIN.fullmatch(word) and not any(s in raw for s in self.special):
            return b"".join(map(self.parts.__getitem__, PRETOKEN.findall(word.lower())))
        ids = self.tok.encode(word, add_special_tokens=False).ids
        return pack("<%dH" % len(ids), *ids)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, words_of(text)))


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that its tasks share the caches."""
    return WordTokens(path)


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary, n, part, local): ids as 16-bit integers with the end id, and the
    offset inside the partition."""

    def make():
        tokens = word_tokens(path)
        part, local = TaskContext.get().partitionId(), [0]
        end = np.array([END_ID], dtype="<u2").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [tokens.ids(t or "") + end for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            starts = local[0] + np.cumsum(sizes) - sizes
            local[0] = int(starts[-1] + sizes[-1])
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes), pa.array([part] * len(ids), pa.int32()), pa.array(starts)],
                names=["doc_id", "ids", "n", "part", "local"],
            )

        return work

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, ids binary, n long, part int, local long", rows=256)


def cut_windows(placed: DataFrame, length: int) -> DataFrame:
    """Boundary records: each document's pieces in the windows that its ids reach into."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for doc, ids, n, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "at")), strict=True):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    out.append((doc, start, size, zlib.crc32(wide[start : start + size].tobytes()), n, (at + start) // length, offset))
                    start += size
            columns = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE_COLUMNS)

        return work

    return arrow_map(placed, make, ", ".join(f"{c} long" for c in PIECE_COLUMNS), rows=512)


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, length: int = 2048, path: str | None = None) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every sequence but the last is full, so there is no padding before the end. Null and
    empty text: one end id. Repeated rows and null doc_ids are packed like any other row.
    An empty table gives no rows; extra columns are not read. Documents of any length are
    cut at window ends only.
    """
    spark = docs.sparkSession
    tokens = cut(tokenise(docs, path or tokenizer_path("word_bpe_49k.json")), "pack-ids")
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per task
    parts = sorted(totals)
    bases = [0, *accumulate(totals[p] for p in parts)]
    base = spark.createDataFrame(list(zip(parts, bases)), "part int, base long")
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("local")).alias("at"))
    return cut_windows(placed, length)
