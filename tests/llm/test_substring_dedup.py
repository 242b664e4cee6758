import time

import brute
import numpy as np
import pyarrow as pa
import pytest
import samples

from glyphloom.llm import substring_dedup
from glyphloom.llm import textblocks as tb
from glyphloom.llm.substring_dedup import remove_repeated_sequences

SCHEMA = "doc_id long, text string"


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = samples.rows(seed)
    got = result(remove_repeated_sequences(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == sorted(brute.repeated_sequences(rows))
    assert sum(x[2] for x in got) > 100


def test_edges(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(5, passage), (3, "a " + passage + " z"), (9, passage), (None, None), (4, "same " * 50), (4, "same " * 50)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", block string, h int")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in remove_repeated_sequences(df).collect()))
    # rows alike in id and text are one document: each keeps the first of its own 20-word windows only
    assert got == [(False, 0, 0), (True, 3, 0), (True, 4, 49), (True, 4, 49), (True, 5, 25), (True, 9, 25)]
    assert remove_repeated_sequences(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_sequences(df, window=10)


def test_long_text(spark):
    text = " ".join(f"v{k * 7919 % 100003}" for k in range(60_000))
    got = result(remove_repeated_sequences(spark.createDataFrame([(1, text), (2, "x " + text), (3, text[:3000])], SCHEMA)))
    assert [x[2] for x in got] == [0, 60_000, len(text[:3000].split()) - (0 if text[3000] == " " else 1)]


def test_time_of_a_bucket_does_not_grow_with_its_senders():
    rng = np.random.default_rng(5)
    n = 200_000
    one, ids = rng.integers(0, n // 3, n).astype(np.uint64), rng.integers(0, 1000, n)
    first = {}
    for k, i in zip(one.tolist(), ids.tolist()):
        first[k] = min(i, first.get(k, i))
    late = np.array([i > first[k] for k, i in zip(one.tolist(), ids.tolist())])

    def seconds(senders):
        rows = [
            {"block": int(at[0])} | tb.packed(one=one[at], two=one[at], id=ids[at], h=ids[at], word=np.zeros(len(at), np.uint32), seq=at.astype(np.uint32))
            for at in np.array_split(np.arange(n), senders)
        ]
        table, took = pa.Table.from_pylist(rows), []
        for _ in range(3):
            begun = time.process_time()
            got = substring_dedup._late_windows(table)
            took.append(time.process_time() - begun)
        assert (np.sort(tb.unpacked(got["seq"], np.uint32)) == np.flatnonzero(late)).all()
        starts = np.array([r["block"] for r in rows])
        for r in got.to_pylist():
            seq = np.frombuffer(r["seq"], np.uint32)
            assert (starts[np.searchsorted(starts, seq, "right") - 1] == r["block"]).all()
        return min(took)

    assert seconds(8000) < 8 * seconds(100)
