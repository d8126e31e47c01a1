import hashlib
import random
import string

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeglass.llm.common import tokenizer_path
from tapeglass.llm.pieces import PieceEncoder, encode_documents
from tapeglass.llm.tokencount import count_tokens

MODEL = tokenizer_path("piece_bpe_32k.model")
ENCODER = PieceEncoder(MODEL)
ODD = ["", " ", "a" * 2000, " " * 3000, "<s>", "</s>x<unk>", "\0a", "<0x41>", "▁", " ▁ a", "\n\n\t", "x" * 99 + "=" * 70, "中文字 😀 é ﬁ　"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENCODER.encode(text) == ENCODER.model.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ENCODER.encode(text) == ENCODER.model.encode(text)


def test_dense_merges():
    draw = random.Random(5)
    for letters in ("thehatandnedser  ", string.ascii_lowercase + " ", "ab "):
        for _ in range(400):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 70)))
            assert ENCODER.encode(text) == ENCODER.model.encode(text)


def test_documents_match_the_library(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "x y")], "doc_id long, text string"))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        packed = np.array(ids, dtype="<u4").tobytes()
        want[r.doc_id] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs).collect()}
    assert got == want
    assert encode_documents(docs.limit(0)).count() == 0


def test_counts_and_cache(spark, data_dir, tmp_path):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "x y"), (-4, "long " * 5000)], "doc_id long, text string"))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r.doc_id: (len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 4096) for r in docs.collect()}
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time everything is known
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, cache).collect()}
        assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content_sha256").distinct().count() == docs.fillna("", "text").select("text").distinct().count()
    assert count_tokens(docs.limit(0), str(tmp_path / "other")).count() == 0
