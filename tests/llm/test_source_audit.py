import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphloom.llm import source_audit as A

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_docs=10, most=10):
    """docs: (lang, source, text)."""
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(SMALL))
        groups[lang].add(source)
        count[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        share = lambda c, n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}  # noqa: E731,B023
        p = {s: share(count[lang, s], sum(count[lang, s][t] for t in kept)) for s in sources}
        all_of = Counter()
        for s in sources:
            all_of.update(count[lang, s])
        q = share(all_of, sum(all_of[t] for t in kept))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(rows)]
    return sorted(out)


def some(seed, n=300):
    rnd = random.Random(seed)
    words = ["Rain", "été", "SUN", "x", "日本", "moon", "o'clock", "Äther", "a1b", "sea"] + [f"w{c}" for c in "abcdefghijklmnop"]
    out = []
    for k in range(n):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s1", "s2", "s3", None, "É"])
        out.append((lang, source, " ".join(rnd.choice(words[: 8 + 6 * (source == "s2")] + words[-4:]) for _ in range(rnd.randrange(30)))))
    return out + [("fr", "only", None), ("fr", "b", ""), ("fr", "b", "1 2 3"), ("it", "alone", "ciao"), ("en", "s1", "sea " * 3000)] + out[:40]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_counts(spark, seed):
    docs = some(seed)
    df = spark.createDataFrame([(k, *d, "x") for k, d in enumerate(docs)], "doc_id long, lang string, source string, text string, term string")
    got = A.audit(df, min_docs=(10, 1, 30)[seed], most=(10, 3, 10)[seed])
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(docs, (10, 1, 30)[seed], (10, 3, 10)[seed])


def test_small_tiles(spark, monkeypatch):
    """Terms of one language in many blocks: partial sums and heaps from each."""
    monkeypatch.setattr(A, "CELLS", 16)
    monkeypatch.setattr(A, "STRIP", 8)
    docs = some(7)
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert sorted(map(tuple, A.audit(df, min_docs=2).collect())) == plain(docs, 2)


def test_empty_table(spark):
    assert A.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_large_counts():
    rnd = random.Random(5)
    for _ in range(300):
        total = rnd.randrange(1, 8 * 10**15)
        count, kept = rnd.randrange(total), rnd.randrange(1, 10**9)
        assert int(A.shares(np.array([count]), np.array([total]), kept)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * kept)
