import random

import brute
import numpy as np
import pytest
import samples

from glyphloom.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def plain(df, **how):
    return sorted(((r.doc_id is not None, r.doc_id or 0, *tuple(r)[1:5]) for r in S.remove_repeated_strings(df, **how).collect()))


def want(rows, size=200):
    return sorted((i is not None, i or 0, *rest) for i, *rest in brute.repeated_bytes(rows, size))


@pytest.mark.parametrize("seed", range(2))
def test_suffix_array(seed):
    rnd = np.random.default_rng(seed)
    runs = [rnd.integers(0, 3, n).astype(np.uint8).tobytes() for n in rnd.integers(1, 300, 12)] + [b"ab" * 90, b"\0" * 70]
    data = np.frombuffer(b"".join(runs), np.uint8)
    end = np.repeat(np.cumsum([len(r) for r in runs]), [len(r) for r in runs])
    order = S.suffix_array(data, end)
    suffix = lambda i: data[i : end[i]].tobytes()
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix(i), i))
    room = end - np.arange(len(data)) - 20 + 1
    own = order[room[order] > 0]
    for lane in (7, 512):
        shared = S.common_prefixes(data, own, room, 20, lane)
        for k in range(1, len(own)):
            a, b = suffix(own[k - 1]), suffix(own[k])
            assert shared[k] == next((j for j in range(20) if a[j] != b[j]), 20)


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, hot):
    rows = samples.rows(2, n=50, words=160)
    passage = " ".join(f"z{k}" for k in range(90))
    rnd = random.Random(hot)
    rows += [(1000 + k, f"{rnd.random()} " * rnd.randrange(8) + passage[rnd.randrange(90) :] + f" {rnd.random()}" * rnd.randrange(9)) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = plain(df, hot=hot)
    assert got == want(rows)
    assert sum(r[3] for r in got) > 10_000


def test_edges(spark):
    rnd = random.Random(9)
    noise = lambda n: "".join(chr(rnd.randrange(97, 123)) for _ in range(n))
    a, b = noise(200), noise(199)
    rows = [(1, a + noise(50)), (2, noise(7) + a), (3, b + "q"), (4, "z" + b), (5, "é" * 400), (6, "x" * 200), (7, "x" * 201), (None, None), (8, ""), (9, noise(300)), (9, None), (None, noise(10)), (10, "ab\0" * 90)]
    rows += [(11, rows[9][1])]
    df = spark.createDataFrame([(*r, "k", 2) for r in rows], SCHEMA + ", block string, h int")
    assert plain(df) == want(rows)
    assert [len(r.kept) for r in S.remove_repeated_strings(df).where("doc_id = 1").collect()] == [50]
    assert S.remove_repeated_strings(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeated_strings(df, size=40)


def test_long_text(spark):
    rnd = random.Random(5)
    text = "".join(chr(rnd.randrange(97, 123)) for _ in range(300_000))
    rows = [(1, text), (2, "-" + text[100_000:250_000] + "+")]
    assert [r[3] for r in plain(spark.createDataFrame(rows, SCHEMA))] == [150_000, 150_000]
