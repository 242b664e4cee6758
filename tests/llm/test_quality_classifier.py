import random
import zlib

import numpy as np
import pytest

from glyphloom.llm import quality_classifier as C
from glyphloom.llm import textblocks as tb


def test_pairwise_sum_is_that_of_all_pairs():
    import pyarrow as pa

    x = C.features(tb.texts_of(pa.array(["a b c a", None, "x " * 40 + "\ny z!"])), 64)
    m = C.FactorisationMachine.empty(64)
    rng = np.random.default_rng(0)
    m.weights[:], m.factors[:], m.bias = rng.normal(size=m.weights.shape), rng.normal(size=m.factors.shape), 0.3
    for i in range(3):
        c, v = x.columns[x.start[i] : x.start[i + 1]], x.values[x.start[i] : x.start[i + 1]]
        margin = m.bias + m.weights[c] @ v + sum(m.factors[c[a]] @ m.factors[c[b]] * v[a] * v[b] for a in range(len(c)) for b in range(a))
        assert m.scores(x)[i] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_held_out_accuracy(spark):
    rnd, docs, labels = random.Random(1), [], []
    for k in range(900):
        good = rnd.random() < 0.7
        words = [rnd.choice(["sun", "moon", "of", "the"] if good or rnd.random() < 0.6 else ["zap!!", "$$buy", "NOW"]) + str(rnd.randrange(30)) for _ in range(rnd.randrange(30, 90))]
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(good)))
    df = spark.createDataFrame(docs + [(None, None, "y"), (5000, "", "y")], "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    machine = C.train(df, known)
    got = {r.doc_id: r for r in C.score(df, machine).collect()}
    out = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sorted(k for k, r in got.items() if r.held_out and k != 5000) == out
    assert np.mean([got[k].predicted == dict(labels)[k] for k in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and not got[None].held_out
    flipped = spark.createDataFrame([(k, 1 - q if k in set(out) else q) for k, q in labels], "doc_id long, quality int")
    assert (C.train(df, flipped).weights == machine.weights).all()
    assert all(r.score == 0.5 for r in C.score(df.limit(5), C.train(df, known.limit(0))).collect())
    assert C.score(df.limit(0), machine).count() == 0


def test_same_number_of_steps_at_every_size(monkeypatch):
    import pyarrow as pa

    taken, sums = [], C.FactorisationMachine._sums
    monkeypatch.setattr(C.FactorisationMachine, "_sums", lambda self, x: taken.append(1) or sums(self, x))
    n_steps = set()
    for n in (0, 1, 40, 300, 3000):
        x = C.features(tb.texts_of(pa.array([f"w{k % 17} w{k % 5}" for k in range(n)], pa.string())), 64) if n else None
        taken.clear()
        C.FactorisationMachine.empty(64).fit(x, np.arange(n) % 5 % 2)
        if n:
            n_steps.add(len(taken))
    assert len(n_steps) == 1


def test_scores_against_the_plain_formula(spark):
    """Every pair of features added one by one."""
    import math

    import pyarrow as pa

    rnd = random.Random(9)
    docs = [(k, " ".join(rnd.choice("sun moon Sea zap!! of the 12".split()) for _ in range(rnd.randrange(25)))) for k in range(60)] + [(60, ""), (61, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    machine = C.train(df, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in C.score(df, machine).collect()}
    for k, text in docs:
        x = C.features(tb.texts_of(pa.array([text], pa.string())), machine.buckets)
        cells = list(zip(x.columns.tolist(), x.values.tolist()))
        total = float(machine.bias) + sum(float(machine.weights[i]) * v for i, v in cells)
        for a, (i, v) in enumerate(cells):
            total += sum(float(machine.factors[i] @ machine.factors[j]) * v * w for j, w in cells[a + 1 :])
        assert abs(got[k] - 1 / (1 + math.exp(-total))) < 1e-4


def test_repeated_ids_and_the_byte_bound(spark, monkeypatch):
    docs = [(k % 50, f"word{k % 50} and more {k}") for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    fitted = []
    fit = C.FactorisationMachine.fit
    monkeypatch.setattr(C.FactorisationMachine, "fit", lambda self, x, y: fitted.append(len(y)) or fit(self, x, y))
    C.train(df, known)
    monkeypatch.setattr(C, "MOST_BYTES", 1000)
    C.train(df, known)
    assert 25 < fitted[0] < 40 and 0 < fitted[1] < fitted[0]
