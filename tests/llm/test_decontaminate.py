import random
from itertools import combinations

from glyphloom.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string"


def test_masks_miss_no_two_substitutions():
    for gone in combinations(range(13), 2):
        assert any(all(o + m not in gone for m in mask) for mask in D.MASKS for o in range(13 - mask[-1]))


def brute(docs, items, stretch=13, percent=80, least=8):
    import re

    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = set()
    for i, t, *_ in docs:
        a = words(t)
        for j, u in items:
            b = words(u)
            size = min(stretch, len(b))
            if len(b) >= least and any(100 * sum(x == y for x, y in zip(a[p : p + size], b[q : q + size])) >= percent * size for p in range(len(a) - size + 1) for q in range(len(b) - size + 1)):
                out.add((i, j))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: f"Wörd{rnd.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rnd.randrange(13, 40)))) for k in range(12)] + [(None, "too short, this"), (50, None)]
    docs = []
    for k in range(60):
        text = [word() for _ in range(rnd.randrange(0, 200))]
        if k % 2:
            part = items[rnd.randrange(12)][1].split()
            a = rnd.randrange(max(1, len(part) - 13))
            part = part[a : a + rnd.randrange(10, 30)]
            for _ in range(k % 5):
                part[rnd.randrange(len(part))] = "other"
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((k, ", ".join(text).upper() if k % 4 == 1 else " ".join(text), 5))
    docs += [(90, None, None), (91, "", 1), (None, items[3][1], 1), (92, items[4][1], 1), (92, items[4][1], 1)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    got = D.find_copies(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 15
    assert len([1 for r in got if r.doc_id == 92 and r.item_id == 4]) == 2
    blocked = D.find_copies(df, bench, block_bytes=500)
    assert sorted(map(str, blocked.collect())) == sorted(map(str, got))
    clean = {str(d[0]) for d in docs} - {str(i) for i, _ in want}
    assert {str(r.doc_id) for r in D.keep_clean(df, bench, block_bytes=500).collect()} == clean
    assert D.keep_clean(df, bench).columns == df.columns
    assert D.find_copies(df, bench.limit(0)).count() == 0 and D.find_copies(df.limit(0), bench).count() == 0
    assert D.keep_clean(df, bench.limit(0)).count() == len(docs)


def test_short_items(spark):
    """Every substitution that the limits allow is found in items of 8 to 12 words, and only whole copies of shorter ones."""
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 13)]
    docs = []
    for n, text in items:
        for lost in range(4):
            for gone in combinations(range(n), lost):
                docs.append((len(docs), " ".join(["before"] * (lost % 2) + ["other" if k in gone else w for k, w in enumerate(text.split())] + ["after"] * (n % 2)), n))
    docs += [(len(docs), f"{items[0][1]} x {items[4][1]} {items[0][1]} {items[4][1].upper()}", 0), (len(docs) + 1, "i5x0 i5x1 i5x2 i5x3", 0)]
    want = brute(docs, items) | {(i, j) for i, t, _ in docs for j, u in items if j < 8 and f" {u} " in f" {t.lower()} "}
    got = D.find_copies(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert {j for _, j in want} == set(range(1, 13))
    assert {(r.n_copied, r.n_equal) for r in got if r.item_id < 8} == {(n, n) for n in range(1, 8)}


def test_masks_miss_nothing_that_is_allowed():
    for size in range(1, 19):
        for lost in range(min(size, 5)):
            masks = [m for _, m in D._masks(size, lost)]
            for gone in combinations(range(size), lost):
                assert any(o + m[-1] < size and not any(o + x in gone for x in m) for m in masks for o in range(size))


def test_other_limits(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(200)}"
    items = [(k, " ".join(word() for _ in range(rnd.randrange(1, 30)))) for k in range(30)]
    docs = []
    for k in range(80):
        part = items[k % 30][1].split()
        for _ in range(k % 6):
            part[rnd.randrange(len(part))] = "other"
        docs.append((k, " ".join([word() for _ in range(9)] + part + [word() for _ in range(7)]), 1))
    for stretch, percent in ((20, 60), (10, 100), (6, 50)):
        got = D.find_copies(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), stretch, percent, 1).collect()
        assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, stretch, percent, 1)
