"""Relations and arc tables against plain tables and against machines."""

import random

import pytest

from glyphloom.errors import ArgumentError, OperationError
from glyphloom.operators import arcs as arcs_module, edit, relation as R
from glyphloom.operators import machine as M
from glyphloom.operators.arcs import ArcTable
from glyphloom.operators.relation import Relation
from glyphloom.semiring import INFINITY


def rows(rel):
    return {(i, o): pytest.approx(w) for i, o, w in rel.items()}


def random_rows(rnd, n=12):
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 3)))
    return [(word(), word(), float(rnd.randrange(-2, 6))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_algebra_equals_machines(spark, seed):
    rnd = random.Random(seed)
    a, b = random_rows(rnd), random_rows(rnd)
    A, B = Relation.of_rows(spark, a), Relation.of_rows(spark, b)
    X, Y = M.string_map(a), M.string_map(b)

    def table(m):
        out = {}
        for i, o, w in M.items(m):
            out[i, o] = min(w, out.get((i, o), INFINITY))
        return out

    assert rows(A) == table(X)
    assert rows(A.union(B).merged()) == table(X | Y)
    assert rows(A.compose(B).merged()) == table(X @ Y)
    assert rows(A.invert()) == table(M.invert(X)) and rows(A.reverse()) == table(M.reverse(X))
    assert rows(A.project("input").merged()) == table(M.project(X, "input"))
    assert rows(A.concat(B).merged()) == table(X + Y)
    assert rows(A.closure(0, 2)) == table(X ** (0, 2))
    assert rows(A.prune(2)) == table(M.prune(X, 2))
    acceptor = B.project("input").merged()
    assert {i for i, _ in rows(A.project("input").difference(acceptor))} == {i for i, _, _ in a} - {i for i, _, _ in b}
    assert rows(A.leniently_compose(B).merged()) == table(M.leniently_compose(X, Y, M.closure(M.union("a", "b"))))
    assert {i for i, _ in rows(A.priority_union(B))} == {i for i, _, _ in a + b}
    assert A.equivalent(A.union(A)) and not A.equivalent(B)
    assert rows(A.disambiguate()) == table(M.disambiguate(X))
    assert A.cross(B.project("input")).df.count() == A.df.count() * B.df.count()
    log = Relation.of_rows(spark, a + a, "log")
    assert rows(log) == {(i, o): w for i, o, w in M.items(M.string_map(a + a, arc_type="log"))}
    assert A.total().first().weight == min(w for _, _, w in a)


def test_weights_and_errors(spark):
    a = Relation.of_rows(spark, [("x", "y", 3), ("x", "z"), "w"])
    assert rows(a) == {("x", "y"): 3.0, ("x", "z"): 0.0, ("w", "w"): 0.0}
    assert rows(a.shortest(1)) == {("x", "z"): 0.0, ("w", "w"): 0.0} and rows(a.weights("times", 2).optimal()) == {("x", "z"): 2.0, ("w", "w"): 2.0}
    for kind, want in (("plus", 1.0), ("power", 6.0), ("rmweight", 0.0), ("invert", -3.0), ("quantize", 3.0)):
        assert a.weights(kind, 1 if kind == "plus" else None, power=2).df.where("ostring = 'y'").first().weight == want
    with pytest.raises(ArgumentError):
        a.union(Relation.of_rows(spark, ["q"], "log"))
    with pytest.raises(OperationError):
        Relation.of_rows(spark, ["q"], "log").prune(1)
    with pytest.raises(ArgumentError):
        a.closure(3, 2)
    with pytest.raises(OperationError):
        a.string()
    table = Relation(spark.range(3).selectExpr("cast(id as string) istring", "'x' ostring", "0.0 weight"))
    assert rows(a.project("input").optimal().cross(table)).keys() == {(i, o) for i in "xw" for o in "012"} and not a.cross(table).bounded
    assert rows(Relation.of_rows(spark, ["q"]).concat(table)).keys() == {(f"q{k}", "qx") for k in range(3)}
    with pytest.raises(OperationError):
        table.closure(1, 2)
    assert Relation.of_rows(spark, [("x", "y")]).string() == "y"
    assert a.matches(spark.createDataFrame([("x", "y"), ("x", "q")], "istring string, ostring string")).count() == 1
    assert a.randgen(2, seed=1).df.count() == 2
    words = spark.createDataFrame([("b",), (None,), ("a",)], "word string")
    assert rows(Relation.of_column(words, "word", weight=2)) == {("a", "a"): 2.0, ("b", "b"): 2.0}


def test_ranking(spark):
    c = spark.createDataFrame([(1, "x", 1.0), (1, "x", 0.5), (1, "y", 0.5 + 1e-9), (1, "z", 2.0), (2, "q", 0.0)], "k int, ostring string, weight double")
    assert sorted((r.k, r.ostring) for r in R.optimal(R.rewrites(c, ["k"]), ["k"]).collect()) == [(1, "x"), (1, "y"), (2, "q")]
    assert [(r.k, r.ostring) for r in R.best(c, ["k"]).orderBy("k").collect()] == [(1, "x"), (2, "q")]
    assert [r.ostring for r in R.only_best(c, ["k"], strict=False).orderBy("k").collect()] == [None, "q"]
    with pytest.raises(Exception, match="x, y"):
        R.only_best(c, ["k"]).collect()
    assert R.top(R.rewrites(c, ["k"]), ["k"], 2).count() == 3


def test_edit_distance(spark):
    e = edit.EditTransducer(frozenset("abcdefghijklmnopqrstuvwxyz"), bound=4)
    assert e.distance("kitten", "sitting") == 3 and e.distance("", "abc") == 3 and edit.EditTransducer(None, 1, 1, 5).distance("a", "b") == 2
    for bad in (("abcdefgh", ""), ("A", "a")):
        with pytest.raises(OperationError):
            e.distance(*bad)
    words = ["cat", "cut", "coat", "dog", "do"]
    auto = edit.LevenshteinAutomaton(e, tuple(words))
    assert auto.closest_matches("ct") == ["cat", "cut"] and auto.closest_match("dgo") == "do"
    lexicon, queries = spark.createDataFrame([(w,) for w in words + [None]], "w string"), spark.createDataFrame([("ct",), ("dgo",), ("zzzzzzzz",), ("cat",), (None,)], "q string")
    got = {r.q: (r.ostring, r.weight) for r in edit.closest(queries, "q", lexicon, "w", 2).collect()}
    assert got == {"ct": ("cat", 1.0), "dgo": ("do", 1.0), "cat": ("cat", 0.0)}
    ties = edit.closest(queries, "q", lexicon, "w", 2, all_ties=True)
    assert sorted(r.ostring for r in ties.where("q = 'ct'").collect()) == ["cat", "cut"]
    costs = edit.distances(queries, "q", lexicon, "w", 3, edit.EditTransducer(None, 1, 1, 3))
    assert {(r.q, r.ostring): r.weight for r in costs.where("q = 'cat'").collect()} == {("cat", "cat"): 0.0, ("cat", "cut"): 2.0, ("cat", "coat"): 1.0}


@pytest.mark.parametrize("seed", range(1))
def test_arc_tables_equal_machines(spark, seed):
    rnd = random.Random(seed)
    m = M.Machine()
    m.add_states(9)
    m.set_start(0)
    for _ in range(16):
        a, b = sorted(rnd.sample(range(9), 2))
        label = rnd.randrange(0, 3)
        m.add_arc(a, label, rnd.choice([label, 0, 2]), rnd.randrange(0, 5), b)
    for s in rnd.sample(range(4, 9), 3):
        m.set_final(s, rnd.randrange(3))
    t = ArcTable.of_machine(spark, m)
    found = lambda x: sorted((tuple(i), tuple(o), w) for i, o, w in M.paths(x))
    assert sorted((tuple(r.ilabels), tuple(r.olabels), r.weight) for r in t.paths().collect()) == found(m)
    assert found(t.connect().to_machine()) == found(m) == found(t.topsort().to_machine())
    assert t.verify() and t.equal(t) and not t.equal(t.invert()) or t.properties()["acceptor"]
    dist = {r.state: r.distance for r in t.shortestdistance().collect()}
    assert dist == {s: d for s, d in enumerate(M.shortestdistance(m)) if d < INFINITY}
    dist = {r.state: r.distance for r in t.shortestdistance(backward=True).collect()}
    assert dist == {s: d for s, d in enumerate(M.shortestdistance(m, backward=True)) if d < INFINITY}
    best = lambda x: {(i, o): min(w for j, p, w in M.paths(x) if (j, p) == (i, o)) for i, o, _ in M.paths(x)}
    assert best(t.rmepsilon().to_machine()) == best(m)
    assert found(t.prune(1).to_machine()) == [p for p in found(m) if p[2] <= min(w for *_, w in found(m)) + 1]
    assert found(t.reverse().to_machine()) == sorted((i[::-1], o[::-1], w) for i, o, w in found(m))
    coded, codes = t.encode(weights=True)
    assert found(coded.decode(codes).to_machine()) == found(m)
    assert best(t.superfinal().to_machine()) == best(m) == best(t.arc_sum().to_machine())
    p = t.properties()
    assert p["acyclic"] and p["acceptor"] == m.properties()["acceptor"]


def test_cyclic_tables(spark):
    m = M.closure("ab")
    t = ArcTable.of_machine(spark, m)
    assert t.order() is None and t.topsort() is t and t.connect().to_machine().num_states() == m.num_states()
    with pytest.raises(OperationError):
        t.paths()
    assert {r.state: r.distance for r in t.shortestdistance().collect()} == {s: 0.0 for s in m.states()}
    pairs = spark.createDataFrame([(97, 98)], "old long, new long")
    assert t.relabel(pairs).arcs.where("ilabel = 97").isEmpty() and not t.relabel(pairs).arcs.where("olabel = 97").isEmpty()
    assert {r.state: r.n_arcs for r in t.counts().collect()} == {s: m.num_arcs(s) for s in m.states()}
    gone = spark.createDataFrame([(0,)], "state long")
    assert t.delete_states(gone).verify()


def test_distances_without_bound_and_with_cheap_edits(spark):
    words = ["", "a", "cat", "widget", "abcdefgh"]
    queries, lexicon = spark.createDataFrame([("ab",), ("plate",), ("",)], "q string"), spark.createDataFrame([(w,) for w in words], "w string")
    for costs in ((1, 1, 1), (0.5, 1, 1), (1, 0.25, 3), (0, 1, 2)):
        edits = edit.EditTransducer(None, *costs)
        for bound in (0, 1, 3):
            got = {(r.q, r.ostring, r.weight) for r in edit.distances(queries, "q", lexicon, "w", bound, edits).collect()}
            assert got == {(q, w, d) for q in ("ab", "plate", "") for w in words if not bound or edits.distance(q, w) <= bound for d in [edits.distance(q, w)]}


def test_negative_cycles_and_endless_sums_are_an_error(spark):
    states = spark.createDataFrame([(k, k == 0, 0.0 if k == 5 else None) for k in range(6)], "state long, is_start boolean, final_weight double")
    rows = [(k, 0, 0, 1.0, k + 1) for k in range(5)]
    arcs = lambda more: spark.createDataFrame(rows + more, "src long, ilabel long, olabel long, weight double, dst long")
    chain = ArcTable(states, arcs([]))
    assert [r.weight for r in chain.paths().collect()] == [5.0]
    assert chain.rmepsilon().states.where("state = 0").first().final_weight == 5.0
    for failing in (lambda t: t.shortestdistance(), lambda t: t.rmepsilon()):
        with pytest.raises(OperationError):
            failing(ArcTable(states, arcs([(3, 0, 0, -4.0, 1)])))


def test_long_chains_take_few_rounds(spark):
    """A chain with a side branch, a ring that nothing leads into, and a loop."""
    n = 300
    rows = [(k, 1, 1, float(k % 5), k + 1) for k in range(n)] + [(100, 2, 2, 1.0, 1000), (2000, 1, 1, 1.0, 2001), (2001, 1, 1, 1.0, 2000)]
    states = [(k, k == 0, 0.5 if k == n else None) for k in [*range(n + 1), 1000, 2000, 2001]]
    for ring in ("tropical", "log"):
        t = ArcTable(spark.createDataFrame(states, "state long, is_start boolean, final_weight double"), spark.createDataFrame(rows, "src long, ilabel long, olabel long, weight double, dst long"), ring)
        assert {r.state: r.distance for r in t.shortestdistance().collect()} == {k: float(sum(j % 5 for j in range(k))) for k in range(n + 1)} | {1000: sum(j % 5 for j in range(100)) + 1.0}
        back = {r.state: r.distance for r in t.shortestdistance(backward=True).collect()}
        assert back == {k: 0.5 + sum(j % 5 for j in range(k, n)) for k in range(n + 1)}
        kept = t.connect()
        assert kept.states.count() == n + 1 and kept.arcs.count() == n
        assert t.order() is None and {r.state: r.level for r in kept.order().collect()} == {k: k for k in range(n + 1)}
        assert kept.topsort().arcs.where("src >= dst").isEmpty()


def test_log_distances_with_cycles_against_a_linear_solve(spark, monkeypatch):
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.random((6, 6)) * (rng.random((6, 6)) < 0.5)
    a /= a.sum(1, keepdims=True).max() * 1.1
    rows = [(i, 0, 0, -math.log(a[i, j]), j) for i in range(6) for j in range(6) if a[i, j] > 0]
    states = spark.createDataFrame([(i, i == 0, -math.log(0.25) if i == 5 else None) for i in range(6)], "state long, is_start boolean, final_weight double")
    arcs = spark.createDataFrame(rows, "src long, ilabel long, olabel long, weight double, dst long")
    t = ArcTable(states, arcs, "log")
    ways = np.linalg.inv(np.eye(6) - a)
    got = {r.state: r.distance for r in t.shortestdistance().collect()}
    assert all(abs(math.exp(-got.get(j, math.inf)) - ways[0, j]) < 1e-6 for j in range(6))
    back = {r.state: r.distance for r in t.shortestdistance(backward=True).collect()}
    assert all(abs(math.exp(-back.get(i, math.inf)) - ways[i, 5] * 0.25) < 1e-6 for i in range(6))
    loud = t._with(arcs=arcs.withColumn("ilabel", (arcs.dst == 5).cast("long")))
    free = loud.rmepsilon()
    silent = a.copy()
    silent[:, 5] = 0
    want = np.linalg.inv(np.eye(6) - silent) @ np.where(np.arange(6) == 5, a, 0)
    assert all(abs(math.exp(-r.weight) - want[r.src, r.dst]) < 1e-6 for r in free.arcs.collect()) and free.arcs.where("ilabel = 0").isEmpty()
    # the largest eigenvalue is 0.44: e^1 times that is above 1, and the sums have no end
    monkeypatch.setattr(arcs_module, "PATIENCE", 24)
    with pytest.raises(OperationError):
        ArcTable(states, arcs.withColumn("weight", arcs.weight - 1.0), "log").shortestdistance()


@pytest.mark.parametrize("ring,back_to_start", [("tropical", True), ("log", False)])
def test_push_keeps_the_weights_of_paths(spark, ring, back_to_start):
    rows = [(0, 1, 1, 1.0, 1), (0, 2, 2, 4.0, 2), (1, 3, 3, 2.0, 3), (2, 3, 3, 1.0, 3), (1, 4, 4, 0.5, 2)] + [(9, 5, 5, 1.0, 9)] + [(3, 6, 6, 9.0, 0)] * back_to_start
    states = spark.createDataFrame([(k, k == 0, {2: 3.0, 3: 0.25}.get(k)) for k in (0, 1, 2, 3, 9)], "state long, is_start boolean, final_weight double")
    t = ArcTable(states, spark.createDataFrame(rows, "src long, ilabel long, olabel long, weight double, dst long"), ring)

    def paths(x, most=6):
        arcs, ends = x.arcs.collect(), {r.state: r.final_weight for r in x.states.collect()}
        now, out = [(r.state, (), 0.0) for r in x.states.where("is_start").collect()], {}
        for _ in range(most + 1):
            out |= {p: w + ends[s] for s, p, w in now if ends[s] is not None}
            now = [(a.dst, p + (a.ilabel,) * (a.ilabel > 0), w + a.weight) for s, p, w in now for a in arcs if a.src == s]
        return {p: w for p, w in out.items() if len(p) < most}

    want = paths(t)
    total = {r.state: r.distance for r in t.shortestdistance(backward=True).collect()}[0]
    for to_final in (False, True):
        got = paths(t.push(to_final))
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        got = paths(t.push(to_final, remove_total_weight=True))
        assert got.keys() == want.keys() and all(abs(got[p] - want[p] + total) < 1e-6 for p in want)
    pushed = t.push()
    ways = {}
    for r in pushed.arcs.collect():
        ways.setdefault(r.src, []).append(r.weight)
    ends = {r.state: r.final_weight for r in pushed.states.collect()}
    import math

    for s in (1, 2, 3):  # from each state the weights now add up to one
        all_of = ways.get(s, []) + [ends[s]] * (ends[s] is not None)
        assert abs(min(all_of) if ring == "tropical" else -math.log(sum(math.exp(-w) for w in all_of))) < 1e-6
    shift = t.states.selectExpr("state", "state + 2.5d AS distance")
    for to_initial in (True, False):
        got = paths(t.reweight(shift, to_initial))
        assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_log_sums_of_far_weights(spark):
    import math

    rows = [("a", "a", -900.0), ("a", "a", -900.0), ("a", "a", 900.0), ("b", "b", 1e5), ("b", "b", 1e5 + 1), ("c", "c", math.inf), ("d", "d", 511.9), ("d", "d", 512.1)]
    x = Relation(spark.createDataFrame(rows, "istring string, ostring string, weight double"), "log")
    got = {r.istring: r.weight for r in x.merged().df.collect()}
    want = {"a": -900 - math.log(2), "b": 1e5 - math.log1p(math.exp(-1)), "c": math.inf, "d": 511.9 - math.log1p(math.exp(-0.2))}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-6 for k in want)
    assert "partial_sum" in x.merged().df._jdf.queryExecution().toString()


def test_bounds_multiply(spark):
    a = Relation.of_rows(spark, [str(k) for k in range(300)])
    assert a.bounded and not a.cross(a).bounded and a.union(a).bounded


def test_near_pairs_miss_nothing(spark):
    """All pairs within the bound, on both ways of joining, against plain distances."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randrange(0, 9))) for _ in range(60)})
    asked = sorted({"".join(rnd.choices("abc", k=rnd.randrange(0, 10))) for _ in range(60)})
    q, w = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in (asked, words))
    for bound, edits in ((1, edit.EditTransducer()), (3, edit.EditTransducer()), (1, edit.EditTransducer(None, 1.0, 0.5, 1.5))):
        want = {(a, b, d) for a in asked for b in words if (d := edits.distance(a, b)) <= bound}
        for most in (50_000, 3):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(edit, "MOST_BROADCAST", most)
                found = [tuple(r) for r in edit.distances(q, "x", w, "x", bound, edits).collect()]
            assert len(found) == len(set(found)) and set(found) == want


def test_no_temporary_folder_on_a_cluster():
    from types import SimpleNamespace

    from glyphloom.operators.arcs import checkpointed

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(OperationError):
        checkpointed(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=conf)))


def test_nearest_without_bound(spark):
    """Bounds that double find what a search of all pairs finds, whatever edits cost, without a product in the plan."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcé") for _ in range(n))
    words = sorted({word(rnd.randrange(0, 12)) for _ in range(60)} | {"x" * 30})
    asked = sorted({word(rnd.randrange(0, 14)) for _ in range(40)} | {"", "yyyyyyyy", "z" * 25})
    q, w = (spark.createDataFrame([(x,) for x in [*side, side[0], None]], "x string") for side in (asked, words))
    for costs in ((1, 1, 1), (1.5, 0.5, 1.25)):
        edits = edit.EditTransducer(None, *costs)
        want = set()
        for a in asked:
            d = {b: edits.distance(a, b) for b in words}
            want |= {(a, b, x) for b, x in d.items() if x == min(d.values())}
        found = edit.closest(q, "x", w, "x", 0, all_ties=True, edits=edits)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert edit.closest(q, "x", w.limit(0), "x", 0).count() == 0 and edit.closest(q.limit(0), "x", w, "x", 0).count() == 0
