"""The pipeline against plain versions of its stages, and each stage over odd rows."""

from __future__ import annotations

import base64

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from dispersa.llm import nbsvm, secret_scan
from dispersa.llm.common import read_table
from pyspark.sql import functions as F

from . import brute


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_run_against_plain_stages(spark, sf_dir, encoding):
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").select("doc_id", "quality")
    model = nbsvm.learn(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score((r.text or "").encode()) >= 0.3]
    after_quality = len(rows)
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    rows = [r for r, c in zip(rows, brute.components(prints), strict=True) if r[0] == c]
    after_copies = len(rows)
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    rows = [r for r, found in zip(rows, brute.contamination([t for _, t in rows], items), strict=True) if not found[4]]
    assert docs.count() > after_quality > after_copies > len(rows) > 0
    want = {}
    for d, text in rows:
        out, end = [], 0
        for _, i, j, _ in secret_scan.find(text or "")[0]:
            if i >= end:
                out.append((text or "")[end:i] + "[secret]")
            end = max(end, j)
        want[d] = encoding.encode_ordinary("".join(out) + (text or "")[end:])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {d: r.token_ids for d, r in got.items()} == want
    assert all(r.n_tokens == len(r.token_ids) for r in got.values())


@pytest.mark.parametrize("k", range(5))
def test_stages_over_odd_rows(spark, sf_dir, k):
    texts = [None, "", "  ", "eins zwei", "x y z " * 9000, "x y z " * 9000, "clean words " * 40, "clean words " * 40]
    rows = [(i if i != 2 else None, t, None, None if i else "s", len(t or ""), i, 0.5, "c") for i, t in enumerate(texts)] + [(3, "eins zwei", "de", "s", 9, 1, 0.5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, count long, score double, n_words string")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf_dir)
    if k < 4:
        assert set(read_table(spark, sf_dir, "documents").columns) <= set(out.columns)
    kept = [r.doc_id for r in out.collect()]
    if name == "SimHash near-dedup":
        assert sorted(d for d in kept if d is not None) == [0, 3, 4, 6] and kept.count(None) == 1
    elif k >= 2:
        assert len(kept) == len(rows)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_keep_their_columns(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    redacted = corpus_pipeline.redact_secrets(spark, docs, sf_dir)
    assert redacted.filter(F.length("text") != F.col("n_chars")).count() == 0
