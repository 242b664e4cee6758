"""Best and random paths, and parentheses, of arc tables."""

import math
import random
from collections import Counter

import pytest
from test_arc_algebra import paths, some

from glyphloom.errors import ArgumentError, OperationError
from glyphloom.operators import arc_paths as W
from glyphloom.operators import arc_stack as S
from glyphloom.operators import machine as M
from glyphloom.operators import pushdown as P
from glyphloom.operators.arcs import ArcTable

@pytest.fixture(autouse=True, scope="module")
def few_rows(spark):
    """Plans of a few rows are not compiled, cut into partitions, or planned anew while they run."""
    quick = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "1"}
    for key, value in quick.items():
        spark.conf.set(key, value)
    yield
    for key in quick:
        spark.conf.unset(key)


STATES, ARCS = "state long, is_start boolean, final_weight double", "src long, ilabel long, olabel long, weight double, dst long"


def shown(df):
    return [(tuple(r.ilabels), tuple(r.olabels), round(r.weight, 6)) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("seed", [0])
def test_best_paths_against_all_paths(spark, seed):
    rnd = random.Random(seed)
    m = some(rnd, 7, 18, 2)
    t = ArcTable.of_machine(spark, m)
    every = sorted(paths(m), key=lambda p: p[2])
    for n in (4, 1000):
        got = shown(W.best_paths(t, n))
        assert [w for *_, w in got] == [w for *_, w in every[:n]] and not Counter(got) - Counter(every)
    assert Counter(got) == Counter(every)
    least = {}
    for i, o, w in every:
        least.setdefault((i, o), w)
    for n in (3,):
        got = shown(W.best_paths(t, n, unique=True))
        assert len({p[:2] for p in got}) == len(got) and [w for *_, w in got] == sorted(least.values())[:n]
        assert all(least[i, o] == w for i, o, w in got)


def test_best_paths_through_cycles(spark):
    rows = [(0, 1, 1, 1.0, 1), (1, 2, 2, 0.5, 1), (1, 0, 0, 0.0, 1), (1, 3, 3, 2.0, 0)]
    t = ArcTable(spark.createDataFrame([(0, True, None), (1, False, 0.25)], STATES), spark.createDataFrame(rows, ARCS))
    got = shown(W.best_paths(t, 4, unique=True))
    assert [(i, w) for i, _, w in got] == [((1,), 1.25), ((1, 2), 1.75), ((1, 2, 2), 2.25), ((1, 2, 2, 2), 2.75)]
    assert [w for *_, w in shown(W.best_paths(t, 3))] == [1.25] * 3
    assert shown(W.best_paths(t._with(states=t.states.limit(0), arcs=t.arcs.limit(0)), 3)) == []
    with pytest.raises(ArgumentError):
        W.best_paths(t, 0)


def test_random_paths_within_exact_bounds(spark):
    rows = [(0, 1, 1, 0.1, 1), (0, 2, 2, 1.0, 1), (0, 3, 0, 2.0, 2), (1, 4, 4, 0.5, 2), (1, 5, 5, 0.5, 0)]
    t = ArcTable(spark.createDataFrame([(0, True, 1.5), (1, False, None), (2, False, 0.7)], STATES), spark.createDataFrame(rows, ARCS))
    n = 4000
    for select in ("uniform", "log_prob"):
        got = W.random_paths(t, n, select, seed=5).collect()
        assert sorted(r.sample for r in got) == list(range(n))
        again = W.random_paths(t, n, select, seed=5).collect()
        assert sorted(got) == sorted(again) and sorted(got) != sorted(W.random_paths(t, n, select, seed=6).collect())
        mass = (lambda w: 1.0) if select == "uniform" else (lambda w: math.exp(-w))
        odds = {None: mass(1.5), 1: mass(0.1), 2: mass(1.0), 3: mass(2.0)}
        first = Counter(r.ilabels[0] if r.ilabels else None for r in got)
        for way, m in odds.items():
            p = m / sum(odds.values())
            # an exact binomial tail of both sides of one in a million
            terms = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)]
            k = first[way]
            assert min(sum(terms[: k + 1]), sum(terms[k:])) > 5e-7
        assert all(len(r.olabels) == len([i for i in r.ilabels if i != 3]) for r in got)
    short = W.random_paths(t, 500, max_length=1).collect()
    assert 0 < len(short) < 500 and all(len(r.ilabels) <= 1 for r in short)
    with pytest.raises(ArgumentError):
        W.random_paths(t, 5, "other")


def test_choices_cover_the_whole_interval(spark):
    rows = [(0, k, k, 0.0, 1) for k in range(1, 3000)]
    t = ArcTable(spark.createDataFrame([(0, True, None), (1, False, 0.0)], STATES), spark.createDataFrame(rows, ARCS))
    got = [(r.low, r.high) for r in W.choices(t).where("state = 0").select("low", "high").distinct().collect()]
    got.sort()
    assert len(got) == 2999 and got[0][0] == 0 and abs(got[-1][1] - 1) < 1e-9 and all(abs(a[1] - b[0]) < 1e-9 for a, b in zip(got, got[1:]))


def test_choices_list_few_rows_a_choice(spark):
    """States with one choice are listed once, and large states by a few rows a choice."""
    rows = [(0, k, k, 0.1 * (k % 9), k) for k in range(1, 800)]
    t = ArcTable(spark.createDataFrame([(0, True, None), *[(k, False, 0.0) for k in range(1, 800)]], STATES), spark.createDataFrame(rows, ARCS))
    for select in ("uniform", "log_prob"):
        got = W.choices(t, select).groupBy((W.F.col("state") == 0).alias("many")).count().collect()
        assert {r["many"]: r["count"] for r in got}[False] == 799 and {r["many"]: r["count"] for r in got}[True] < 3 * 799


PUSH, POP = 91, 93


def nested(spark, n):
    """a^n b^n as brackets: 0 pushes and loops, 1 pops and loops."""
    rows = [(0, PUSH, PUSH, 1.0, 1), (1, 97, 97, 0.0, 0), (0, 0, 0, 0.0, 2), (2, 98, 98, 0.5, 3), (3, POP, POP, 0.0, 2)]
    return ArcTable(spark.createDataFrame([(0, True, None), (1, False, None), (2, False, 0.0), (3, False, None)], STATES), spark.createDataFrame(rows, ARCS))


def test_balanced_ways_of_any_depth(spark):
    parens = spark.createDataFrame([(PUSH, POP)], "push long, pop long")
    depth = 12
    rows = [(k, PUSH, PUSH, 1.0, k + 1) for k in range(depth)] + [(depth, 5, 5, 0.5, depth + 1)] + [(k, POP, POP, 0.25, k + 1) for k in range(depth + 1, 2 * depth + 1)]
    end = 2 * depth + 1
    t = ArcTable(spark.createDataFrame([(k, k == 0, 3.0 if k in (end, end - 1) else None) for k in range(end + 1)], STATES), spark.createDataFrame(rows, ARCS))
    assert [tuple(r) for r in S.balanced_shortest(t, parens).collect()] == [(end, 3.5 + 1.25 * depth)]
    loops = S.balanced_shortest(nested(spark, 3), parens).collect()
    assert [tuple(r) for r in loops] == [(2, 0.0)]
    with pytest.raises(OperationError):
        S.balanced(t._with(arcs=t.arcs.withColumn("weight", t.arcs.weight - 2)), parens)


@pytest.mark.parametrize("seed", [1])
def test_balanced_and_expanded_against_pushdown_machines(spark, seed):
    rnd = random.Random(seed)
    m = M.Machine()
    m.add_states(7)
    m.set_start(0)
    for _ in range(16):
        a, b = sorted(rnd.sample(range(7), 2))
        label = rnd.choice([1, 2, 0, 91, 93, 93, 60, 62])
        m.add_arc(a, label, label, rnd.randrange(4), b)
    for s in (5, 6):
        m.set_final(s, rnd.randrange(3))
    t = ArcTable.of_machine(spark, m)
    triples = [(91, 93), (60, 62)]
    want = M.connect(P.expand(m, P.Parentheses(triples)))
    parens = spark.createDataFrame(triples, "push long, pop long")
    made = S.expand(t, parens)
    assert paths(made.to_machine()) == paths(want)
    best = min((r.weight for r in S.balanced_shortest(t, parens).collect()), default=None)
    assert best == min((w for *_, w in paths(want)), default=None)


def test_replace_and_recursion(spark):
    noun, s = 1000, 1001
    make = lambda m: ArcTable.of_machine(spark, m)
    root = make(M.concat("a ", M.of_labels([noun]), " or ", M.of_labels([noun])))
    table, parens = S.replace(root, {noun: make(M.union("cat", "dog"))})
    got = {"".join(map(chr, i)) for i, _, _ in paths(S.expand(table, parens).to_machine())}
    assert got == {f"a {x} or {y}" for x in ("cat", "dog") for y in ("cat", "dog")} and parens.count() == 2
    again, marks = S.replace(make(M.of_labels([s])), {s: make(M.union(M.accep("", 1), M.concat("a", M.of_labels([s]), "b")))})
    assert [r.weight for r in S.balanced_shortest(again, marks).collect()] == [1.0]
    with pytest.raises(OperationError):
        S.expand(again, marks, budget=50)
    alone, none = S.replace(root, {})
    assert none.isEmpty() and alone.arcs.count() == root.arcs.count()
