import math
import random

import duckdb
import numpy as np
import pytest

from glyphloom.llm import queries as Q
from glyphloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, vector string"


def plain(rows, k=32):
    """rows: (id, list or None) -> {id: (n, deviation, values)}, explained and directions from the covariance itself."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, total = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - s for a, s in zip(r, total)] for r in x]
    centred = np.array([[float(a) / n for a in r] for r in d])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return {"n": n, "deviation": [sum(a * a for a in r) for r in d], "e": e, "trace": np.trace(centred.T @ centred / n), "w": centred @ v / np.sqrt(np.maximum(e, 1e-300)), "ids": [i for i, _ in good]}


def held(got, want):
    rank = int((want["e"] > 1e-11 * want["e"][0]).sum())
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by, key=str) == sorted(set(want["ids"]), key=str) and len(got) == len(want["ids"]) * rank
    sign = {}
    for place, i in enumerate(want["ids"]):
        for r in by[i]:
            k = r.component - 1
            value = want["w"][place, k]
            sign.setdefault(k, 1 if r.whitened * value >= 0 else -1) if abs(value) > 1e-6 else None
            assert (r.n, r.deviation) == (want["n"], want["deviation"][place])
            assert r.whitened == pytest.approx(sign.get(k, 1) * value, abs=1e-7)
            assert r.explained == pytest.approx(want["e"][k] / want["trace"], rel=1e-7) and r.identity_error <= 1e-4


def test_against_the_covariance(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.gauss(0, 1 + j) + (3 if k % 3 else 0) for j in range(7)]) for k in range(200)]
    rows += [(900, None), (901, [math.nan] + [1.0] * 6), (902, [1.0, None] + [1.0] * 5), (903, [math.inf] + [0.0] * 6), (904, [-math.inf] * 7)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows] + [(905, [1.0], 0, ""), (906, [], 0, "")], SCHEMA).repartition(5)
    held(W.whiten(df).collect(), plain(rows))
    held(W.whiten(df, components=2).collect(), plain(rows, 2))


def test_repeated_rows_null_ids_and_lost_directions(spark):
    rnd = random.Random(4)
    base = [[rnd.random(), rnd.random()] for _ in range(30)]
    rows = [(k, [a, b, a, 0.25]) for k, (a, b) in enumerate(base)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    got = W.whiten(df).collect()
    assert {r.component for r in got} == {1, 2}
    held(got, plain(rows))
    twice = spark.createDataFrame([(None, v, 0, "") for _, v in rows] * 2, SCHEMA)
    assert len(W.whiten(twice).collect()) == 120


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1e9, 2.0]), (1, [-3e9, 5.0]), (2, [7e13, -1e14]), (3, [0.0, 1e16])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    want = plain(rows)
    got = {r.vec_id: r.deviation for r in W.whiten(df).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in zip(want["ids"], want["deviation"])}
    assert W.whiten(spark.createDataFrame([(0, [1e300, 1.0], 0, ""), (1, [0.0, 2.0], 0, "")], SCHEMA)).count() == 2


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 0, "")], [(1, [1.0, 2.0], 0, "")], [(1, [1.0], 0, ""), (2, [1.0], 0, "")], [(1, [], 0, "")], [(1, [math.nan], 0, "")]):
        df = W.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    held(Q.QUERIES["op11_embedding_whitening"](spark, sf).collect(), plain(rows))
