import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from plumbline.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def test_same_ids_as_the_library_on_odd_spacing(vocabulary, library):
    texts = ["", " ", "  ", "a ", "a  ", "a\n ", "a \n", "a\n \nb", "x   y", "   x", "\t x", "it's I'LL we're", "12３４½", "<|endoftext|>",
             " <|endoftext|> a<|endoftext|>", "a՘b Ᲊc", "\U0001f600​ é", "x" * 500 + " " + "ab" * 400]
    for text in texts:
        ids = np.frombuffer(vocabulary.encode(text), np.int32)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert vocabulary.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_array_and_heap_agree(vocabulary):
    for word in (b"aaaaaaaaab", b"thethethe", bytes(range(256)), b" " * 40):
        parts = [vocabulary.first[b] for b in word]
        assert vocabulary._by_array(parts[:]) == vocabulary._by_heap(parts[:])


def test_bytes_that_are_no_text(vocabulary, library):
    for ids in ([130, 131, 220, 200], [50256, 1], [199, 199]):
        assert vocabulary.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)
    assert vocabulary.decode(np.array([-1, 10**9], np.int32)) == ""


def test_query_against_the_library(spark, sf, library):
    got = {r.doc_id: r for r in queries.op1_bpe_roundtrip(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(row.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edge_cases(spark, edge_docs, empty_docs, library):
    tokenizer = bpe.Tokenizer(spark, PATH)
    rows = tokenizer.decode(tokenizer.encode(edge_docs)).collect()
    assert len(rows) == edge_docs.count()
    for row in rows:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded == (row.text or "")
    assert tokenizer.decode(tokenizer.encode(empty_docs)).count() == 0
    assert tokenizer.decode(spark.sql("SELECT CAST(NULL AS array<int>) AS ids")).first().decoded == ""


def test_many_words_at_once_agree_with_one_by_one(vocabulary):
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 102, n).tolist()) for n in rng.integers(1, bpe.WIDE + 1, 400)] + [b"the", b" ", b"x", bytes(range(128, 160))]
    for some in (words, words[:1], [b"a"]):
        assert vocabulary.many(some) == [np.array(vocabulary.word(w), np.int32).tobytes() for w in some]


def test_texts_together_and_small_caches(vocabulary, library, spark, sf, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ["", " ", "a  b", "<|endoftext|> x", "q" * 300 + " y", "a՘b c՘", "one\ntwo three###"]
    monkeypatch.setattr(bpe, "TOGETHER", 500)
    monkeypatch.setattr(bpe, "KEPT_STRETCHES", 300)
    got = [np.frombuffer(p, np.int32).tolist() for p in vocabulary.encode_all(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(vocabulary.kept) <= 800 and len(vocabulary.kept.old) <= 800


def test_round_trip_is_encode_and_decode(spark, edge_docs, empty_docs):
    tokenizer = bpe.Tokenizer(spark, PATH)
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "ids", "decoded").collect()))
    assert key(tokenizer.round_trip(edge_docs)) == key(tokenizer.decode(tokenizer.encode(edge_docs)))
    assert tokenizer.round_trip(empty_docs).count() == 0
    plan = tokenizer.round_trip(edge_docs).select("ids", "decoded")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
