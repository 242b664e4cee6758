import random
import re
from collections import Counter
from math import comb

import brute
import pytest
import samples

from glyphloom.llm import quality_rules as Q


def counts(text):
    text = text or ""
    w = brute.words(text)
    windows = [tuple(w[p : p + 3]) for p in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {p + k for p, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if brute.words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), len(re.findall("[A-Z]", text)), text.count("!"))


def test_counts(spark):
    rows = samples.rows(1) + [(900, "a b c\n a b c\na b c\n\n\n#!X|é\r\n"), (901, "é" * 9000 + "\n" + "ü ß\n" * 50)]
    df = spark.createDataFrame([(*r, "en", 7) for r in rows], "doc_id long, text string, lang string, n_words int").repartition(3)
    got = {r.doc_id: tuple(r.quality_counts) for r in Q.statistics_of(df).collect()}
    assert got == {i: counts(t) for i, t in rows}
    with pytest.raises(ValueError):
        Q.statistics_of(df, to="N_words")
    assert Q.statistics_of(df.limit(0)).count() == 0


def test_binomial():
    for n, k, p in [(10, 3, 0.2), (50, 0, 0.01), (200, 5, 0.05), (5, 5, 0.3)]:
        assert Q.at_most(k, n, p) == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))


def made(n_good, n_bad, seed=0):
    rnd, docs, labels = random.Random(seed), [], []
    for k in range(n_good + n_bad):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
        if k >= n_good:
            words = [w + "$$" for w in words]
        docs.append((k, " ".join(words), "en"))
        labels.append((k, int(k < n_good), 0))
    return docs, labels


def test_cutoffs_need_enough_labels(spark):
    docs, labels = made(2000, 100)
    df, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in Q.judge(df, known).collect()}
    assert all(kept[k] == (k < 2000) for k in kept)
    assert sorted(r.doc_id for r in Q.keep_good(df, known).collect()) == list(range(2000))
    few = known.where("doc_id < 100 or doc_id > 2050")
    assert all(r.kept for r in Q.judge(df, few).collect())
    assert all(r.kept for r in Q.judge(df, known.limit(0)).collect())
    assert Q.judge(df.limit(0), known).count() == 0


def test_null_labels_and_languages(spark):
    docs = [(1, "x " * 60, None), (None, None, "en"), (2, " ".join(f"a{k}" for k in range(60)), "zz"), (2, " ".join(f"a{k}" for k in range(60)), "zz")]
    known = spark.createDataFrame([(None, 1, 0), (2, None, 0), (2, 1, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id or 0), r.base_failed, r.kept) for r in Q.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), known).collect())
    assert got == [(0, True, False), (1, True, False), (2, False, True), (2, False, True)]


def test_false_rejections_stay_within_the_risk():
    """A set that hits more good documents than allowed is called safe with at most the stated probability, exactly."""
    rules = Q.RiskControlledRules()
    for n in (50, 90, 150, 600, 3000):
        allowed = [k for k in range(n + 1) if rules.safe([k], n)]
        assert allowed == list(range(len(allowed)))
        worst = Q.at_most(len(allowed) - 1, n, rules.total_risk) if allowed else 0
        assert worst <= rules.level and (n < 90) == (not allowed)
    assert rules.safe([0, 0, 60, 0], 150) == 2 and rules.safe([], 150) == 0


def test_simulated_risk():
    """Proposals on one part, nested tests on the other: at most delta of the runs lose too much."""
    rnd, rules, bad = random.Random(5), Q.RiskControlledRules(), 0
    for _ in range(300):
        rates = sorted(rnd.choice((0.0, 0.02, 0.049, 0.052, 0.08)) for _ in range(3))
        draws = [rnd.random() for _ in range(200)]
        done = rules.safe([sum(x < r for x in draws) for r in rates], 200)
        bad += done > 0 and rates[done - 1] > rules.total_risk
    assert bad <= 300 * 0.05


def test_columns_with_names_that_are_used_inside(spark):
    docs, labels = made(400, 40)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, quality_counts int, n_words int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = Q.keep_good(df, known)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(400))


def test_rows_and_texts_that_repeat_certify_nothing_more(spark):
    docs, labels = made(120, 40, seed=3)
    few, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fit = lambda df, labels: Q.RiskControlledRules().fit(Q.statistics_of(df).select("doc_id", "lang", Q._digest().alias("digest"), "quality_counts.*"), labels).cutoffs
    once = fit(few, known)
    often = spark.createDataFrame(docs * 10, "doc_id long, text string, lang string")
    assert fit(often, known) == once and not once.get("en")
    # the same texts under other ids, with labels of their own
    copies = spark.createDataFrame([(k + 1000 * c, t, l) for k, t, l in docs for c in range(10)], "doc_id long, text string, lang string")
    labelled = spark.createDataFrame([(k + 1000 * c, q, t) for k, q, t in labels for c in range(10)], "doc_id long, quality int, toxic int")
    assert fit(copies, labelled) == once
    many, enough = made(600, 60, seed=3)
    got = fit(spark.createDataFrame(many + many[:50], "doc_id long, text string, lang string"), spark.createDataFrame(enough, "doc_id long, quality int, toxic int"))
    assert got["en"]
    # an id with two texts is one draw; of ids with one text, one bad label makes it bad
    pair = [(1, "a " * 5 + " ".join(f"b{k}" for k in range(60)), "en"), (1, " ".join(f"c{k}" for k in range(60)), "en"), (2, " ".join(f"d{k}" for k in range(60)), None), (3, " ".join(f"d{k}" for k in range(60)), "zz")]
    counted = Q.statistics_of(spark.createDataFrame(pair, "doc_id long, text string, lang string")).select("doc_id", "lang", Q._digest().alias("digest"), "quality_counts.*")
    draws = Q.RiskControlledRules().labelled(counted, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")).collect()
    assert sorted((r.stratum, r.good) for r in draws) == [("en", True), (Q.OTHER, False)]
