"""Terms of a lexicon table in texts, by both ways, against a plain search."""

import random

import pytest
from compare import connection, difference

from glyphloom.errors import ArgumentError
from glyphloom.operators import term_tags as G
from glyphloom.plans.queries import QUERIES, SQL


def plain(text, terms):
    longest, i, out = max(map(len, terms), default=0), 0, []
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 0, -1) if text[i : i + n] in terms), 0)
        if n:
            out.append((i, n))
        i += n or 1
    return out


def wrapped(text, spans):
    for start, n in reversed(spans):
        text = f"{text[:start]}<k>{text[start : start + n]}</k>{text[start + n :]}"
    return text


@pytest.mark.parametrize("most", [G.MOST_BROADCAST, 64])
def test_against_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(G, "MOST_BROADCAST", most)
    monkeypatch.setattr(G, "BLOCK", 3000)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abé😀 ") for _ in range(n))
    terms = {word(rnd.randrange(1, 9)) for _ in range(300)} - set("abé😀 ") | {"a" * 40, "."}
    texts = [word(rnd.randrange(60)) for _ in range(200)] + ["", None, "a" * 5000 + "." + word(2000), "퟿.", *[word(30)] * 1] + ["ab" * 20] * 50
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "k int, `the.text` string, term string, block string").repartition(3)
    lexicon = spark.createDataFrame([(t,) for t in [*terms, *list(terms)[:9], "", None]], "term string")
    want = {k: None if t is None else plain(t, terms) for k, t in enumerate(texts)}
    got = G.term_spans(docs, "the.text", lexicon, "term")
    assert got.columns == [*docs.columns, "spans"]
    assert {r.k: None if r.spans is None else [tuple(s) for s in r.spans] for r in got.collect()} == want
    made = {r.k: r.tagged for r in G.tagged(docs, "the.text", lexicon, "term", "k").collect()}
    assert made == {k: None if t is None else wrapped(t, want[k]) for k, t in enumerate(texts)} and len(made) == len(texts)
    assert sorted(r.tagged for r in G.tagged(docs.where("k < 2"), "the.text", lexicon.limit(0), "term", "k").collect()) == sorted(texts[:2])
    assert G.tagged(docs.limit(0), "the.text", lexicon, "term", "k").count() == 0
    with pytest.raises(ArgumentError):
        G.tagged(docs, "the.text", lexicon, "term", "k", out="block")


def test_query_by_join(spark, monkeypatch):
    """The query over a lexicon that is not sent to the tasks."""
    monkeypatch.setattr(G, "MOST_BROADCAST", 1024)
    sf = "/root/testdata/sf0.001"
    assert difference(QUERIES["tag_table"](spark, sf), connection(sf), SQL["tag_table"]) is None


def test_terms_take_few_bytes_and_batches_go_by_blocks(monkeypatch):
    """What every Python worker holds: the lexicon by hashes and letters, and a block of a batch at a time."""
    import pickle
    import tracemalloc

    rnd = random.Random(2)
    words = [f" {rnd.randrange(10**9, 10**10)}" for _ in range(100_000)]
    made = pickle.dumps(G.Terms([words]))
    tracemalloc.start()
    terms = pickle.loads(made)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 35 * len(words)
    assert terms.spans([f"a{words[5]}{words[7]}0", words[9][:-1], ""]) == [[(1, 11), (12, 11)], [], []]
    monkeypatch.setattr(G, "BLOCK", 1000)
    import pyarrow as pa

    class Shared:
        value = terms

    batch = pa.record_batch([pa.array(list(range(500))), pa.array([words[k] * 3 if k % 7 else None for k in range(500)])], ["k", "t"])
    got = list(G._mapper(Shared, "t", "x")([batch]))
    assert len(got) > 10 and max(b.num_rows for b in got) < 60
    assert [r["made"] for b in got for r in b.to_pylist()] == [f"<x>{words[k]}</x>" * 3 if k % 7 else None for k in range(500)]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(G.Windows, "at", lambda self, at, size: self.sums[at] * 0)
    terms = {"abcd", "bcda", "cd", "dd", "aaaaa"}
    got = G.Terms([sorted(terms)]).spans(["abcdcdbcdaaaaaadd", "dcba"])
    assert got == [plain("abcdcdbcdaaaaaadd", terms), []]
