import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from glyphloom.llm import queries as Q
from glyphloom.llm import textblocks as tb
from glyphloom.llm import toxicity as X

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INSULTS = ["zounds", "knave", "varlet", "schurke", "schurkisch", "été"]


def plain_terms(text):
    out = []
    for word in WORD.findall((text or "").translate(SMALL)):
        raw = word.encode()
        out.append((raw, "whole"))
        out += [(raw[:k], "begins") for k in range(X.SHORTEST, X.LONGEST + 1) if k < len(raw) and raw[k] & 0xC0 != 0x80]
    return out


def plain_counts(text):
    c = Counter(plain_terms(text))
    return c + Counter((t, "again") for t, n in c.items() if n > 1)


def some(n, seed=1):
    rnd, docs, labels = random.Random(seed), [], []
    for k in range(n):
        bad = rnd.random() < 0.2
        words = [rnd.choice("Sun moon of the rain stone étage Äther".split()) + rnd.choice(["", "s", "lich", str(rnd.randrange(9))]) for _ in range(rnd.randrange(10, 60))]
        words += [rnd.choice(INSULTS) for _ in range(rnd.randrange(2, 5) if bad else rnd.random() < 0.03)]
        rnd.shuffle(words)
        docs.append((k, " ".join(words), "toxic", 1.0))
        labels.append((k, int(bad)))
    return docs, labels


def test_terms_are_words_and_their_beginnings():
    texts = ["The CAT's étage, étages; été 12 x", "", "a", "日本語のテキスト " * 3, "  ... ", "Straße" * 30, "the the there"]
    text, term = X.terms_of(tb.texts_of(pa.array(texts)))
    names = {}
    for i, t in enumerate(texts):
        want, got = Counter(plain_terms(t)), Counter(term[text == i].tolist())
        assert sorted(want.values()) == sorted(got.values())
        by_count = {c: sorted(h for h in got if got[h] == c) for c in set(got.values())}
        if len(want) == 1:
            names[next(iter(want))] = by_count[next(iter(want.values()))][0]
    whole = lambda words: set(X.terms_of(tb.texts_of(pa.array(words)))[1].tolist())
    assert whole(["there"]) & whole(["the there"]) == whole(["there"]) and not whole(["ther"]) & whole(["there"])
    assert len(whole(["thereby"]) & whole(["therein"])) == 2


@pytest.mark.parametrize("block", [1, 4, 64])
def test_nearest_against_all_examples(block):
    rng = np.random.default_rng(block)
    width, n, m, k = 40, 150, 90, 7
    dense = rng.integers(0, 4, (n + m, width)) * (rng.random((n + m, width)) < 0.12)
    dense[5], dense[6:9], dense[n + 2], dense[n + 3 : n + 9] = 0, dense[9], 0, dense[9]
    row, place = np.nonzero(dense)
    rows = X.Rows(np.searchsorted(row, np.arange(n + m + 1)), place, dense[row, place].astype(float))
    weight = rng.random(width) + 1
    examples, queries = rows.part(0, n), rows.part(n, n + m)
    ids = rng.permutation(n)
    index = X.Index(examples, ids, np.arange(n) % 2, weight, block)
    query, point, cosine = index.nearest(queries.weighted(weight), k)
    scaled = dense * weight
    unit = scaled / np.maximum(np.sqrt((scaled**2).sum(1)), 1e-300)[:, None]
    s = np.round(unit[n:] @ unit[:n].T, 12)
    kinds = {}
    for e in range(n):
        kinds.setdefault(dense[e].tobytes(), []).append(e)
    for q in range(m):
        want = sorted((-round(s[q, es[0]], 9), min(ids[es]), len(es), sum(e % 2 for e in es)) for es in kinds.values() if s[q, es[0]] > 0)[:k]
        at = point[query == q]
        assert want == list(zip(-np.round(cosine[query == q], 9), index.least[at], index.n[at], index.bad[at]))


def test_steps_are_the_isotonic_fit():
    rnd = random.Random(2)
    vote = np.array([rnd.randrange(12) / 11 for _ in range(80)] + [-1.0] * 10)
    toxic = np.array([int(rnd.random() < abs(v)) for v in vote])
    fit = X.Calibration.of(vote, toxic)
    # min over ends of max over begins of the mean in between
    values = sorted(set(vote[vote >= 0]))
    for i, v in enumerate(values):
        want = min(max(toxic[(vote >= a) & (vote <= b)].mean() for a in values[: i + 1]) for b in values[i:])
        assert fit(np.array([v]))[0] == pytest.approx(want)
    assert fit(np.array([-1.0]))[0] == toxic[80:].mean() and (np.diff(fit(np.linspace(0, 1, 50))) >= 0).all()


def plain_scores(docs, labels):
    """Every document against every example, in dictionaries."""
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    known = {i: y for i, y in labels if i is not None and y is not None and not out_of(i)}
    texts = {}
    for i, t in docs:
        if i in known:
            texts[i] = min(texts.get(i, t or ""), t or "")
    counts = {i: plain_counts(t) for i, t in texts.items()}
    n1, n0 = sum(known[i] for i in counts), sum(1 - known[i] for i in counts)
    bad, good = Counter(), Counter()
    for i, c in counts.items():
        (bad if known[i] else good).update(c.keys())
    pull = lambda seen, of: seen * math.log(seen / of) if seen else 0.0
    space = []
    for t in set(bad) | set(good):
        a, b, share = bad[t], good[t], (bad[t] + good[t]) / (n1 + n0)
        if X.LEAST_EXAMPLES <= a + b < n1 + n0 and max(a / n1, b / n0) >= X.LEAST_LIFT * min(a / n1, b / n0) and 2 * (pull(a, n1 * share) + pull(b, n0 * share) + pull(n1 - a, n1 * (1 - share)) + pull(n0 - b, n0 * (1 - share))) >= X.LEAST_RATIO:
            space.append(t)
    all_counts = [plain_counts(t) for _, t in docs]
    df = Counter(t for c in all_counts for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in space}

    def vector(c):
        v = {t: c[t] * idf[t] for t in space if t in c}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples = {i: vector(c) for i, c in counts.items()}

    kinds = {}
    for i, c in counts.items():
        kinds.setdefault(tuple(sorted((t, c[t]) for t in space if t in c)), []).append(i)

    def vote(i, v):
        near = [(-round(min(1.0, sum(x * examples[js[0]].get(t, 0) for t, x in v.items())), 12), min(js), [j for j in js if j != i]) for js in kinds.values()]
        seats, whole, bad = X.NEIGHBOURS, 0.0, 0.0
        for c, _, js in sorted(x for x in near if x[0] < 0 and x[2]):
            weight = min(seats, len(js)) / (1 + c + X.NEAR)
            seats -= min(seats, len(js))
            whole, bad = whole + weight, bad + weight * sum(known[j] for j in js) / len(js)
        return bad / whole if whole else -1.0

    fit = X.Calibration.of(np.round([vote(i, v) for i, v in examples.items()], 9), np.array([known[i] for i in examples]))
    return [(i, float(fit(np.round([vote(i, vector(c))], 9))[0])) for (i, _), c in zip(docs, all_counts)]


def test_scores_against_dictionaries(spark, monkeypatch):
    docs, labels = some(160)
    docs += [(900, None, "", None), (901, "", "", None), (None, "zounds knave", "", None), *docs[:5]]
    known = labels + [(None, 1), (3, None), (7000, 1)]
    of = X.Calibration.of
    monkeypatch.setattr(X.Calibration, "of", lambda vote, toxic: of(np.round(vote, 9), toxic))
    call = X.Calibration.__call__
    monkeypatch.setattr(X.Calibration, "__call__", lambda self, vote: call(self, np.round(vote, 9)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double").repartition(3)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(X)
    try:
        got = X.score(df, spark.createDataFrame(known, "doc_id long, toxic int")).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(X)
    key = lambda x: sorted((str(i), round(p, 9)) for i, p in x)
    assert key((r.doc_id, r.score) for r in got) == key(plain_scores([(d[0], d[1]) for d in docs], known))
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.evidence == sorted(r.evidence, key=lambda e: (-e.similarity, e.doc_id)) and all(e.examples >= max(1, e.toxic) for e in r.evidence) for r in got)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = some(600)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source double")
    out = {k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1}
    run = lambda given: {r.doc_id: r for r in X.score(df, spark.createDataFrame(given, "doc_id long, toxic int")).collect()}
    got = run(labels)
    assert {k for k in got if got[k].held_out} == out
    assert np.mean([got[k].predicted == y for k, y in labels if k in out]) > 0.95
    flipped = run([(k, 1 - y if k in out else y) for k, y in labels])
    assert all(flipped[k].score == got[k].score for k in got)


def test_nothing_to_learn_from(spark):
    docs, labels = some(30)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.score(df, none).collect()} == {0.5}
    assert {r.score for r in X.score(df, spark.createDataFrame([(k, 0) for k, _ in labels], "doc_id long, toxic int")).collect()} == {0.0}
    assert X.score(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.QUERIES["op12_toxicity"](spark, sf).collect()}
    ids = [i for (i,) in duckdb.sql(f"select doc_id from '{sf}/documents.parquet'").fetchall()]
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    assert sorted(got) == sorted(ids) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == y for i, y in labels.items() if got[i].held_out]) > 0.9
