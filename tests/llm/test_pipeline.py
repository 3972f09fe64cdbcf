"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from cairnwork.llm import quality
from test_operators import brute_decontam, brute_near

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_quality(docs, labels):
    x = quality.statistics([t.encode() for t in docs.values()])
    at = {d: i for i, d in enumerate(docs)}
    taught = [(at[d], q) for d, q in labels if d in at and q in (0, 1) and zlib.crc32(str(d).encode()) % 4 != 2]
    density = []
    for y in (0, 1):
        own = x[[i for i, q in taught if q == y]]
        cov = np.cov(own.T, bias=True)
        share = max(0.05, len(cov) / (len(own) + len(cov)))
        cov = (1 - share) * cov + share * np.diag(np.maximum(np.diag(cov), 0) + 1e-3) + 1e-4 * np.eye(len(cov))
        away = x - own.mean(axis=0)
        density.append(np.log(len(own) / len(taught)) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)))
    score = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality.TEMPER, -500, 500)))
    return {d for d, s in zip(docs, score, strict=True) if s >= 0.7}


def test_stages(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY 1").fetchall())
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = frame.columns
    expected, kept = [], dict(docs)
    good = plain_quality(kept, labels)
    kept = {d: t for d, t in kept.items() if d in good}
    expected.append(set(kept))
    first = {}
    for d, t in kept.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    kept = {d: kept[d] for d in first.values()}
    expected.append(set(kept))
    near = brute_near(list(kept.items()))
    kept = {d: t for d, t in kept.items() if near[d][0] == d}
    expected.append(set(kept))
    hit = brute_decontam(list(kept.items()), items)
    kept = {d: t for d, t in kept.items() if not hit[d][1]}
    expected.append(set(kept))
    assert len(set(map(len, [docs, *expected]))) >= 4, "stages must have something to do"
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        frame = stage(spark, frame, DATA)
        assert frame.columns == columns, name
        rows = frame.collect()
        assert sorted(r.doc_id for r in rows) == sorted(wanted), name
        assert all(r.text == docs[r.doc_id] for r in rows)
        frame = spark.createDataFrame(rows, frame.schema)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(expected[-1])
    for r in out:
        ids = lib.encode(docs[r.doc_id], add_eos=True)
        assert r["ids"] == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_stages_of_nothing(spark):
    frame = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, DATA).count() == 0


def test_without_labels_the_filter_keeps_what_is_predicted_good(spark):
    from cairnwork.llm import quality

    docs = spark.createDataFrame([(1, "Some text."), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.score_quality(docs, labels).collect()} == {(0.5, 0)}
    assert quality.keep_good(docs, labels).count() == 0
    assert quality.keep_good(docs, labels, threshold=0.5).count() == 2
