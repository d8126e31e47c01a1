import zlib

import numpy as np
from tokenizers import Tokenizer

from tapeglass.llm.common import tokenizer_path
from tapeglass.llm.packing import pack_documents

ODD = [
    "", None, "   ", "It's  Él ½ x²  ½ İstanbul ΑΣ 'S can'T we'll <|endoftext|> a<|startoftext|>b é x\x1cy\x85z",
    "...'s ''s 're'ré Å", "中文字 😀😀 ٣٤ a　b", "word " * 5000, "x" * 3000,
]


def test_pieces_hold_every_id_once(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = docs.unionByName(odd)
    pieces = pack_documents(rows, length=2048).collect()
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows.collect()}
    got = {}
    for p in pieces:
        mine = np.array(ids[p.doc_id], dtype="<u4")
        assert p.doc_tokens == len(mine)
        assert zlib.crc32(mine[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        got.setdefault(p.doc_id, []).append((p.start, p.length))
    for doc, parts in got.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert got.keys() == ids.keys()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for number, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or number == max(by_sequence)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, "c", "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    pieces = pack_documents(docs, length=4).collect()
    assert sum(p.length for p in pieces) == 3 + 3 + 2 + 1
    assert sum(p.start == 0 for p in pieces) == 4
    assert pack_documents(docs.limit(0)).count() == 0
