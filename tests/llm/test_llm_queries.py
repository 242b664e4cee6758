"""The opN_ queries against their SQL, or against plain versions, on the smallest tables."""

import base64
import os
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from compare import connection, difference
from tokenizers import Tokenizer

from glyphloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def result(spark, name, n=None):
    return sorted(tuple(r)[:n] for r in Q.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_sql(spark, name):
    assert difference(Q.QUERIES[name](spark, SF), connection(SF), Q.ORACLE_SQL[name]) is None


def test_dedup(spark, rows):
    assert result(spark, "op1_suffix_dedup") == sorted(brute.repeated_bytes(rows))
    assert result(spark, "op2_substring_dedup") == sorted(brute.repeated_sequences(rows))
    assert result(spark, "op3_ngram_jaccard") == sorted(brute.linked(rows))


def test_tokens(spark, rows):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = lambda ids: np.array(ids, "<u4").tobytes()
    want = [(i, len(ids := own.encode_ordinary(t or "")), brute.sha(raw(ids)), brute.sha((t or "").encode())) for i, t in rows]
    assert result(spark, "op4_byte_bpe") == sorted(want)
    t, want, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(raw(ids))))
        start += len(ids)
    assert result(spark, "op10_token_files") == want


def test_classifier_and_leaks(spark, rows):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in Q.QUERIES["op7_quality_classifier"](spark, SF).collect()}
    assert got.keys() == {i for i, _ in rows} and all(0 <= r.score <= 1 for r in got.values())
    out = [i for i in labels if got[i].held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1} == {i for i in got if got[i].held_out}
    assert np.mean([got[i].predicted == labels[i] for i in out]) >= 0.8
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    leaks = {(r.doc_id, r.item_id) for r in Q.QUERIES["op8_decontamination"](spark, SF).collect()}
    assert {(i, j) for i, t in rows for j, b in items if b in (t or "")} <= leaks


def test_pipeline_keeps_what_its_stages_keep(spark, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        columns = docs.columns
        docs = stage(spark, docs, SF)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        names.append((name, len(before), len(after)))
    assert len(names) == 5 and names[-1][2] > 0


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline
    import tiktoken
    from test_decontaminate import brute as leaks
    from test_line_dedup import plain as lines

    con = connection(SF)
    con.sql(f"create table verdict as {Q.ORACLE_SQL['op6_quality_rules']}")
    docs = con.sql("select doc_id, text, source from documents join verdict using (doc_id) where kept").fetchall()
    docs = [(w[0], w[4]) for w in lines(docs)]
    docs = [d for d, (_, n, c) in zip(docs, brute.linked(docs)) if n == 0 or c == d[0]]
    gone = {i for i, _ in leaks(docs, con.sql("select item_id, text from benchmark").fetchall())}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(ids := own.encode_ordinary(t)), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.encode())) for i, t in docs if i not in gone]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
