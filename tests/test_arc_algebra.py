"""Products, classes, best and random paths of arc tables, against machines of a few states."""

import random

import pytest
from pyspark.sql import functions as F

from glyphloom.errors import ArgumentError, OperationError
from glyphloom.operators import arc_classes as K
from glyphloom.operators import arc_product as X
from glyphloom.operators import machine as M
from glyphloom.operators import rounds
from glyphloom.operators.arcs import ARCS, ArcTable


@pytest.fixture(autouse=True, scope="module")
def few_rows(spark):
    """Plans of a few rows are not compiled, cut into partitions, or planned anew while they run."""
    quick = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "1"}
    for key, value in quick.items():
        spark.conf.set(key, value)
    yield
    for key in quick:
        spark.conf.unset(key)


def some(rnd, n=6, arcs=12, labels=3, acceptor=False, silent=True, weights=4):
    m = M.Machine()
    m.add_states(n)
    m.set_start(0)
    for _ in range(arcs):
        a, b = sorted(rnd.sample(range(n), 2))
        i = rnd.randrange(0 if silent else 1, labels + 1)
        m.add_arc(a, i, i if acceptor else rnd.randrange(0 if silent else 1, labels + 1), rnd.randrange(weights), b)
    for s in rnd.sample(range(n // 2, n), 2):
        m.set_final(s, rnd.randrange(weights))
    return m


def paths(m):
    return sorted((tuple(i), tuple(o), round(w, 6)) for i, o, w in M.paths(m))


def best(m):
    out = {}
    for i, o, w in paths(m):
        out[i, o] = min(w, out.get((i, o), 1e9))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_compose_gives_each_pair_of_paths_once(spark, seed):
    rnd = random.Random(seed + 7)
    a, b = some(rnd, labels=2), some(rnd, labels=2)
    t, u = ArcTable.of_machine(spark, a), ArcTable.of_machine(spark, b)
    want = sorted((i, p, v + w) for i, o, v in paths(a) for j, p, w in paths(b) if o == j)
    assert want
    for name in (("auto", "match"), ("alt_sequence",))[seed]:
        assert paths(X.compose(t, u, name).to_machine()) == want, name
    if seed:
        trivial, null = (paths(X.compose(t, u, name, connect=False).to_machine()) for name in ("trivial", "null"))
        assert set(trivial) == set(want) and len(trivial) >= len(want) and set(null) <= set(want)
        return
    made, pairs = X.compose_pairs(t, u)
    assert made.verify() and pairs.count() == made.states.count() == pairs.select("left", "right", "filter").distinct().count()
    with pytest.raises(ArgumentError):
        X.compose(t, u, "other")


def test_compose_with_cycles(spark):
    t, u = (ArcTable.of_machine(spark, m) for m in (M.closure(M.cross("a", "bb")), M.closure(M.cross("b", "c"))))
    made = X.compose(t, u)
    ends = X.compose(ArcTable.of_machine(spark, M.accep("aa")), made, connect=False)
    assert {o for _, o, _ in paths(ends.to_machine())} == {(99,) * 4}
    assert X.compose(t, ArcTable.of_machine(spark, M.accep("x"))).states.isEmpty()


def rows_sent(spark, since=0):
    """Rows of the tables that queries have sent to all tasks through the driver."""
    store = spark._jsparkSession.sharedState().statusStore()
    out = []
    for x in range(since, store.executionsCount()):
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                metrics = (node.metrics().apply(k) for k in range(node.metrics().size()))
                out += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return out


def test_large_tables_do_not_pass_through_the_driver(spark, monkeypatch):
    """However small their files are."""
    monkeypatch.setattr(rounds, "FEW_NUMBERS", 1000, raising=False)
    n = 2000
    leaf = F.col("id") + 2
    arcs = lambda src, silent: spark.range(n).select(F.lit(src).cast("long").alias("src"), leaf.alias("ilabel"), leaf.alias("olabel"), F.lit(0.0).alias("weight"), leaf.alias("dst")).unionByName(
        spark.createDataFrame([(0, 0, 0, 0.0, 1)] if silent else [], ARCS))
    states = spark.range(n + 2).select(F.col("id").alias("state"), (F.col("id") == 0).alias("is_start"), F.when(F.col("id") > 1, 0.0).alias("final_weight"))
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    made, pairs = X.compose_pairs(ArcTable(states, arcs(1, True)), ArcTable(states, arcs(0, False)), "match")
    assert (pairs.count(), made.states.where("final_weight is not null").count(), made.arcs.count()) == (n + 2, n, n + 1)
    sent = rows_sent(spark, since)
    assert sent and max(sent) < n


@pytest.mark.parametrize("seed", [0])
def test_intersect_and_difference(spark, seed):
    rnd = random.Random(seed + 10)
    a, b = some(rnd, acceptor=True), some(rnd, acceptor=True, silent=False, weights=1)
    t, u = ArcTable.of_machine(spark, a), ArcTable.of_machine(spark, b)
    strings = {i for i, _, _ in paths(b)}
    assert paths(X.intersect(t, u).to_machine()) == sorted((i, o, v + w) for i, o, v in paths(a) for j, _, w in paths(b) if i == j)
    sure = K.determinize(u)
    assert paths(X.difference(t, sure).to_machine()) == [p for p in paths(a) if p[0] not in strings]
    if seed:
        return
    with pytest.raises(ArgumentError):
        X.difference(t, t)
    with pytest.raises(ArgumentError):
        X.intersect(t, t.project("input").relabel(opairs=spark.createDataFrame([(1, 9)], "old long, new long")))


@pytest.mark.parametrize("seed,ring", [(1, "tropical"), (0, "log")])
def test_determinize_and_minimize(spark, seed, ring):
    import math

    rnd = random.Random(seed + 20)
    a = some(rnd, 7, 16, 2, acceptor=True, silent=False)
    t = ArcTable.of_machine(spark, a)
    t = ArcTable(t.states, t.arcs, ring)
    want = {}
    for i, _, w in paths(a):
        old = want.get(i)
        want[i] = w if old is None else min(old, w) if ring == "tropical" else -math.log(math.exp(-old) + math.exp(-w))
    sure = K.determinize(t)
    assert sure.arcs.groupBy("src", "ilabel").count().where("count > 1").isEmpty() and sure.verify()
    small = K.minimize(sure)
    for made in (sure, small):
        got = paths(made.to_machine())
        assert {i for i, _, _ in got} == want.keys() and len(got) == len(want) and all(abs(w - want[i]) < 1e-5 for i, _, w in got)
    if ring == "tropical":
        assert small.states.count() <= M.minimize(M.determinize(M.rmepsilon(a))).num_states()
        assert K.equivalent(sure, small) and K.isomorphic(small, K.minimize(K.determinize(small)))


def test_minimal_states_of_words_and_cycles(spark):
    words = ["tap", "taps", "top", "tops", "at"]
    t = K.determinize(ArcTable.of_machine(spark, M.rmepsilon(M.union(*words))))
    small = K.minimize(t)
    endings = {frozenset(w[k:] for w in words if w.startswith(p)) for v in words for k in range(len(v) + 1) for p in [v[:k]]}
    assert small.states.count() == len(endings) and {i for i, _, _ in paths(small.to_machine())} == {tuple(map(ord, w)) for w in words}
    rows = [(k, 97 + k % 2, 97 + k % 2, 0.0, (k + 1) % 6) for k in range(6)]
    states = [(k, k == 0, 0.0 if k % 2 == 0 else None) for k in range(6)]
    ring = ArcTable(spark.createDataFrame(states, "state long, is_start boolean, final_weight double"), spark.createDataFrame(rows, "src long, ilabel long, olabel long, weight double, dst long"))
    assert K.minimize(ring).states.count() == 2


def test_weighted_cycles_stay_equivalent(spark):
    rows = [(k, 97 + k % 2, 97 + k % 2, 0.0, (k + 1) % 4) for k in range(4)]
    states = [(k, k == 0, 0.0 if k % 2 == 0 else None) for k in range(4)]
    ring = ArcTable(spark.createDataFrame(states, "state long, is_start boolean, final_weight double"), spark.createDataFrame(rows, "src long, ilabel long, olabel long, weight double, dst long"))
    heavy = ring._with(arcs=ring.arcs.withColumn("weight", ring.arcs.src % 2 + 1.0), states=ring.states.selectExpr("state", "is_start", "final_weight + 2 AS final_weight"))
    less = K.minimize(heavy)
    assert K.equivalent(heavy, less) and less.states.count() <= 4


def test_no_deterministic_form_and_errors(spark):
    rows = [(0, 1, 1, 0.0, 1), (0, 1, 1, 0.0, 2), (1, 1, 1, 1.0, 1), (2, 1, 1, 2.0, 2)]
    states = spark.createDataFrame([(0, True, None), (1, False, 0.0), (2, False, 5.0)], "state long, is_start boolean, final_weight double")
    t = ArcTable(states, spark.createDataFrame(rows, "src long, ilabel long, olabel long, weight double, dst long"))
    with pytest.raises(OperationError):
        K.determinize(t, budget=5)
    with pytest.raises(ArgumentError):
        K.minimize(t)
    other = t._with(arcs=t.arcs.withColumn("olabel", t.arcs.ilabel + 1))
    with pytest.raises(ArgumentError):
        K.determinize(other)
    none = ArcTable(states.limit(0), t.arcs.limit(0))
    assert K.determinize(none).states.isEmpty() and K.minimize(none).states.isEmpty() and K.equivalent(none, none)


def test_pairs_of_labels(spark):
    m = M.string_map([("ab", "xy"), ("ab", "xz"), ("cb", "xy")])
    made = K.optimize(ArcTable.of_machine(spark, m), pairs=True)
    assert best(made.to_machine()) == best(m) and made.arcs.groupBy("src", "ilabel", "olabel").count().where("count > 1").isEmpty()


def test_counterexamples_and_renumbering(spark):
    make = lambda *words: K.determinize(ArcTable.of_machine(spark, M.rmepsilon(M.union(*words))))
    a, b = make("cat", "car", "dog"), make("dog", "cat", "car")
    assert K.equivalent(a, b) and K.counterexample(a, b).isEmpty() and K.isomorphic(a, b)
    assert K.renumbering(a, b).count() == a.states.count()
    c = make("cat", "car", "do", "dog")
    (row,) = K.counterexample(a, c).collect()
    assert ("".join(map(chr, row.labels)), row.weight_a, row.weight_b) == ("do", None, 0.0) and not K.isomorphic(a, c)
    heavier = a._with(arcs=a.arcs.withColumn("weight", (a.arcs.ilabel == ord("g")).cast("double")))
    (row,) = K.counterexample(a, heavier).collect()
    assert ("".join(map(chr, row.labels)), row.weight_a, row.weight_b) == ("dog", 0.0, 1.0) and not K.isomorphic(a, heavier)
    longer = make("cat", "car", "dogs")
    assert len(K.counterexample(a, longer).collect()) == 1
    assert K.equivalent(K.minimize(a), a) and not K.isomorphic(K.minimize(a), a)
