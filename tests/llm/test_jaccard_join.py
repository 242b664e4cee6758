import random

import brute
import pytest
import samples

from glyphloom.llm import jaccard_join as J
from glyphloom.llm.components import components

SCHEMA = "doc_id long, text string"


def near_copies(seed, n=60, words=60):
    """A large family of near copies, a chain, and texts that share a passage only."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(words)] = f"e{rnd.randrange(1000)}"
        out.append(" ".join(t))
    chain = [f"c{k}" for k in range(words)]
    for k in range(12):
        chain[5 * k % words] = f"n{k}"
        out.append(" ".join(chain))
    passage = [f"p{k}" for k in range(20)]
    out += [" ".join(passage + [f"u{seed}_{k}_{j}" for j in range(rnd.randrange(0, 12))]) for k in range(40)]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    texts = near_copies(seed) + samples.texts(seed, n=50, words=40) + [None, "", "A b", "a  B", "a b c", "one", None]
    random.Random(seed).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, "en", 3) for r in rows], SCHEMA + ", h string, n int").repartition(3)
    want = brute.linked(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.linked_groups(df).collect())
    assert got == sorted(want)
    assert len({c for _, _, c in want}) < len(want) - 70
    kept = J.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, n, c in want if i == c)


def test_edges(spark):
    long = " ".join(f"v{k * 7919 % 100003}" for k in range(30_000))
    rows = [(7, long), (7, long), (None, long + " x"), (3, None), (3, None), (9, "q " * 500), (2, "q " * 40), (4, "q q q q"), (None, "r s t"), (None, "r s t")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in J.linked_groups(df).collect() if r.component_id is not None)
    assert got == [(-1, 29997, 7), (2, 1, 2), (3, 0, 3), (3, 0, 3), (4, 1, 4), (7, 29996, 7), (7, 29996, 7), (9, 1, 2)]
    kept = sorted((r.doc_id or -1, len(r.text or "")) for r in J.keep_one_of_each(df).collect())
    assert kept == [(-1, 5), (-1, len(long) + 2), (2, 80), (3, 0), (3, 0), (4, 7)]
    assert J.linked_groups(df.limit(0)).count() == 0 and J.keep_one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    links = [(k, k + 1) for k in range(300)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)] + [(5000, k) for k in range(5001, 5400)] + [(9, 9)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent)}


@pytest.mark.parametrize("large,few,part", [(2, 16, 3), (8, 1, 1000), (1000, 0.4, 7)])
def test_parts_of_groups_meet(spark, monkeypatch, large, few, part):
    """The same links, however labels, tokens, members and visitors are dealt."""
    texts = near_copies(5, n=40) + loose_copies(6)
    rows = list(enumerate(texts))
    monkeypatch.setattr(J, "LARGE", large)
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "PART_ROWS", part)
    monkeypatch.setattr(J, "DENSE", part)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.linked_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(brute.linked(rows))


def loose_copies(seed, n=60, words=70):
    """Copies of a text that is not there itself: most of them link with few others or none."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        t = [f"l{k}" for k in range(words)]
        for _ in range(2):
            t[rnd.randrange(words)] = f"x{rnd.randrange(6)}"
        out.append(" ".join(t))
    return out


def test_no_table_of_pairs_grows_with_a_group(spark, monkeypatch):
    """Links that tasks hand on: fewer than labels for each place where they meet, whatever the group's size."""
    made = []
    joined = J._label_links
    monkeypatch.setattr(J, "_label_links", lambda *a: made.append(joined(*a)) or made[-1])
    for n in (100, 400):
        texts = loose_copies(7, n)
        got = {r.doc_id: r.component_id for r in J.linked_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
        assert got == {i: c for i, _, c in brute.linked(list(enumerate(texts)))}
    assert all(links.count() < 4 * n for n, links in zip((100, 400), made))


def test_equal_sets_of_texts_that_other_blocks_own(spark, monkeypatch):
    """Copies of a text in many blocks, and variants with the same shingles in each of them."""
    monkeypatch.setattr(J.tb, "MEGABYTE", 4000)
    texts = []
    for k in range(6):
        text = " ".join(f"w{k}_{j}" for j in range(12))
        texts += [text] * 40 + [text.upper(), text.replace(" ", "  "), text.title(), text + " "] * 5
        again = f"r{k} s{k} t{k} u{k} v{k} " * 3
        texts += [again] * 20 + [again * n for n in range(2, 8)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, SCHEMA)
    assert J.tb.blocks_of(df).n_blocks >= 8
    want = brute.linked(rows)
    assert len({c for _, _, c in want}) == 12
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.linked_groups(df).collect()) == sorted(want)
    assert sorted(r.doc_id for r in J.keep_one_of_each(df).collect()) == sorted(i for i, n, c in want if i == c)


def test_no_temporary_folder_on_a_cluster():
    from types import SimpleNamespace

    from glyphloom.llm.textblocks import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=conf)))
