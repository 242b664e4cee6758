import random
from collections import defaultdict

import brute

from glyphloom.llm.line_dedup import drop_boilerplate, line_digests

SCHEMA = "doc_id long, text string, source string, n_chars long, host int, block string"


def plain(rows, percent=5, min_pages=5):
    pages, total = defaultdict(set), defaultdict(int)
    for k, (_, t, s) in enumerate(rows):
        total[s] += 1
        for x in (t or "").split("\n"):
            pages[s, x].add(k)
    bad = {key for key, p in pages.items() if key[0] is not None and len(p) >= 2 and (len(p) >= min_pages or 2 * len(p) > total[key[0]]) and 100 * len(p) > percent * total[key[0]] and brute.words(key[1])}
    out = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = "\n".join(x for x in lines if (s, x) not in bad)
        out.append((i, sum(bool(brute.words(x)) for x in lines), sum((s, x) in bad for x in lines), brute.sha(kept.encode()), kept))
    return out


def rows():
    rnd, out = random.Random(4), []
    common = [f"cömmon {k} line" for k in range(12)] + ["", " ", "\t"]
    for k in range(400):
        lines = [rnd.choice(common[: 3 + k % 12]) if rnd.random() < 0.3 else f"own {rnd.randrange(900)}" for _ in range(rnd.randrange(1, 20))]
        out.append((k, "\n".join(lines) + rnd.choice(["", "\n", "\r\n"]), rnd.choice(["a", "a", "a", "b", "c", None, ""])))
    return out + [(500, None, "a"), (501, "", "b"), (None, "cömmon 1 line\n" * 3000, "a"), (3, out[3][1], out[3][2])]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, s, len(t or ""), 1, "x") for i, t, s in data], SCHEMA).repartition(4)
    want = plain(data)
    got = [tuple(r) for r in line_digests(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted(got, key=key) == sorted([w[:4] for w in want], key=key)
    assert sum(w[2] for w in want) > 300
    whole = drop_boilerplate(df, length_col="n_chars")
    assert whole.columns == df.columns
    texts = [(r.doc_id, r.text or "", r.n_chars, r.source, r.host) for r in whole.collect()]
    source = [s for _, _, s in data]
    assert sorted(texts, key=str) == sorted([(w[0], w[4], len(w[4]), s, 1) for w, s in zip(want, source)], key=str)
    assert sum(r.text is None for r in whole.collect()) == 1
    assert line_digests(df.limit(0)).count() == 0 and drop_boilerplate(df.limit(0)).count() == 0


def test_hosts_of_few_pages(spark):
    """One page alone repeats nothing; of two to four, lines on more than half go."""
    data = [(10 * n + k, "same\nhalf\n" * (k < n // 2 + 1) + ("pair\n" if k < 2 else "") + f"own {k}", f"h{n}") for n in range(1, 13) for k in range(n)]
    df = spark.createDataFrame([(i, t, s, len(t), 1, "x") for i, t, s in data], SCHEMA).repartition(3)
    want = plain(data)
    assert sorted(tuple(r) for r in line_digests(df).collect()) == sorted(w[:4] for w in want)
    kept = {w[0]: w[4] for w in want}
    assert kept[10] == data[0][1] and kept[20] == "own 0" and kept[40] == "pair\nown 0" and kept[120] == "pair\nown 0"
