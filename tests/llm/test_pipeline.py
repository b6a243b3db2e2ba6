"""Each stage of the pipeline on its own input, against plain Python."""

import importlib.util
import os
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def helper(name):
    """Another test module of this folder."""
    spec = importlib.util.spec_from_file_location(name, os.path.join(os.path.dirname(__file__), f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def stages(spark, sf):
    from plumbline.llm.common import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf)))
    return out


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_toxicity_keeps_rows_as_they_are(stages):
    before, after = ({tuple(r) for r in s.collect()} for s in stages[:2])
    assert after < before and len(after) > 0.7 * len(before)


def test_lines(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[1:3])
    want = helper("test_line_dedup").slow([(r.doc_id, r.text) for r in before.values()])
    assert {(d, r.text) for d, r in after.items()} == {(d, text) for (d, _), text in want.items()}
    assert all(r.n_chars == len(r.text) and r.source == before[d].source for d, r in after.items())


def test_near_duplicates(stages):
    slow = helper("test_simhash")
    before, after = (s.collect() for s in stages[2:4])
    prints = [(r.doc_id, slow.slow_fingerprint(r.text)) for r in before]
    kept = {least for least in slow.slow_components(prints)}
    assert sorted(r.doc_id for r in after) == sorted(kept)


def test_mixing(stages):
    before, after = (s.collect() for s in stages[3:5])
    size = Counter()
    for r in before:
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in after:
        taken[r.source] += len(r.text.split())
    want = helper("test_mixing").slow_targets(size)
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_encoding(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = (s.collect() for s in stages[4:6])
    assert sorted(library.encode(r.text, add_special_tokens=False).ids for r in before) == sorted(r.ids for r in after)
    assert all(r.round_trip for r in after)


def test_run_and_edge_cases(spark, sf, edge_docs, empty_docs, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1].count()
    for docs in (edge_docs, empty_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "bpe" or out.columns == docs.columns
            rows = out.collect()
            assert rows or docs is empty_docs
    kept = corpus_pipeline.drop_near_duplicates(spark, edge_docs, sf).collect()
    assert Counter((r.doc_id, r.text) for r in kept).most_common(1)[0][1] == 1
