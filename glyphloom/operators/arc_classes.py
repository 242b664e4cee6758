"""Determinization, minimization and comparison of arc tables.

A set of states, or a class of states, is named by 128 bits: two hashes of its members,
combined by exclusive or.  So no set is ever collected in a row, sets are named by grouping,
which combines before the shuffle, and one state of a third of all arcs is no hot row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, OperationError
from ..semiring import FINE_DELTA, same
from .arcs import ArcTable
from .rounds import Growing, Rounds, numbered

BUDGET = 10_000_000
_SET = ["h1", "h2"]
_LABELS = ["ilabel", "olabel"]


def _level(w: Column, delta: float) -> Column:
    """Weights that differ by rounding only are one."""
    return F.floor(w / delta + 0.5).cast("long")


def _names(*parts: Column) -> list[Column]:
    """Two independent hashes of a member, combined over a group."""
    return [F.bit_xor(F.xxhash64(F.lit(salt), *parts)).alias(h) for salt, h in ((17, "h1"), (71, "h2"))]


def _need_pairs(t: ArcTable, what: str, pairs: bool) -> None:
    if not pairs and not t.arcs.where("ilabel <> olabel").isEmpty():
        raise ArgumentError(f"{what} of a transducer: pairs=True takes pairs of labels for one")


def determinize(t: ArcTable, budget: int = BUDGET, pairs: bool = False, delta: float = FINE_DELTA) -> ArcTable:
    """No two arcs of a state with one label; epsilon counts as a label.

    Weighted subset construction.  A subset is rows (name, state, residual); a round follows all
    arcs of the subsets that are new, adds the weights of equal ends, divides by the sum of each
    label, and names the subsets that this makes.  More than `budget` of them are an error; so a
    table that has no deterministic form ends there.
    """
    _need_pairs(t, "determinization", pairs)
    ring, rounds = t.semiring, Rounds(t.arcs.sparkSession)
    arcs = rounds(t.arcs.withColumnRenamed("src", "state"))
    start = t.states.where("is_start").select("state", F.lit(0.0).alias("rest"))
    member = lambda state: (F.col(state), _level(F.col("rest"), delta))
    name = start.groupBy(F.lit(1).alias("k")).agg(*_names(*member("state"))).select(*_SET)
    members = Growing(rounds, [*_SET, "state"], name.withColumn("k", F.lit(1)).join(start.withColumn("k", F.lit(1)), "k").select(*_SET, "state", "rest"))
    first = members.new
    sets = Growing(rounds, _SET, first.select(*_SET).distinct())
    made, n = None, 1
    while members.n_new:
        moved = members.new.join(arcs, "state").select(*_SET, *_LABELS, "dst", (F.col("rest") + F.col("weight")).alias("weight"))
        ends = rounds(ring.sums(moved, [*_SET, *_LABELS, "dst"]))
        whole = ring.sums(ends, [*_SET, *_LABELS]).withColumnRenamed("weight", "whole")
        ends = ends.join(whole, [*_SET, *_LABELS]).select(*_SET, *_LABELS, "dst", "whole", (F.col("weight") - F.col("whole")).alias("rest"))
        named = ends.groupBy(*_SET, *_LABELS).agg(F.min("whole").alias("weight"), *[c.alias(x) for c, x in zip(_names(*member("dst")), ("to1", "to2"))])
        if made is None:
            made = Growing(rounds, [], named)
        elif not made.put(named):
            break
        if not sets.add(made.new.select(F.col("to1").alias("h1"), F.col("to2").alias("h2")).distinct()):
            break
        n += sets.n_new
        if n > budget:
            raise OperationError(f"determinization makes more than {budget} states")
        # the members of a new set are those of the first way to it
        way = made.new.join(sets.new.toDF("to1", "to2"), ["to1", "to2"]).groupBy("to1", "to2").agg(F.min(F.struct(*_SET, *_LABELS)).alias("way")).select("to1", "to2", "way.*")
        members.put(ends.join(way, [*_SET, *_LABELS]).select(F.col("to1").alias("h1"), F.col("to2").alias("h2"), F.col("dst").alias("state"), "rest"))
    number = rounds(numbered(rounds, sets.all, "n"))
    of = lambda a, b, to: number.toDF(a, b, to)
    finals = t.states.where("final_weight is not null").select("state", "final_weight")
    weight = ring.sums(members.all.join(finals, "state").select(*_SET, (F.col("rest") + F.col("final_weight")).alias("final_weight")), _SET, "final_weight")
    begin = first.select(*_SET).distinct().withColumn("is_start", F.lit(True))
    states = number.join(weight, _SET, "left").join(begin, _SET, "left").select(F.col("n").alias("state"), F.coalesce("is_start", F.lit(False)).alias("is_start"), "final_weight")
    if made is None:
        made_arcs = t.arcs.limit(0)
    else:
        made_arcs = made.all.join(of("h1", "h2", "src"), _SET).join(of("to1", "to2", "dst"), ["to1", "to2"]).select("src", *_LABELS, "weight", "dst")
    states, made_arcs = rounds.done(states, made_arcs)
    return ArcTable(states, made_arcs, ring)


def _deterministic(t: ArcTable, what: str) -> None:
    if not t.arcs.groupBy("src", *_LABELS).count().where("count > 1").isEmpty():
        raise ArgumentError(f"{what} needs a deterministic table")


def _unweighted(t: ArcTable) -> bool:
    return t.arcs.where("weight <> 0").isEmpty() and t.states.where("final_weight <> 0").isEmpty()


def classes(rounds: Rounds, t: ArcTable, delta: float = FINE_DELTA) -> DataFrame:
    """(state, h1, h2): states of a deterministic table with equal names read the same strings with the same weights.

    Without cycles states are named once, those without arcs first; with cycles names are
    refined until there are no more of them.
    """
    end = F.when(F.col("final_weight").isNotNull(), _level(F.col("final_weight"), delta))
    own = rounds(t.states.select("state", F.xxhash64(F.lit(3), end).alias("e")))
    arcs = rounds(t.arcs.select(F.col("src").alias("state"), *_LABELS, _level(F.col("weight"), delta).alias("w"), "dst"))

    def signed(some: DataFrame, known: DataFrame) -> DataFrame:
        met = arcs.join(some.select("state"), "state", "left_semi").join(known.select(F.col("state").alias("dst"), F.col("h1").alias("d1"), F.col("h2").alias("d2")), "dst")
        made = met.groupBy("state").agg(*_names(*_LABELS, "w", "d1", "d2"))
        return some.join(made, "state", "left").select("state", F.xxhash64("e", F.coalesce("h1", F.lit(0))).alias("h1"), F.xxhash64(F.lit(5), "e", F.coalesce("h2", F.lit(0))).alias("h2"))

    height = t._with(arcs=t.arcs.select(F.col("dst").alias("src"), *_LABELS, "weight", F.col("src").alias("dst"))).order()
    if height is not None:
        by_height = rounds(own.join(height, "state"))
        top = by_height.agg(F.max("level")).first()[0]
        named = Growing(rounds, ["state"], signed(by_height.where("level = 0"), own.select("state", F.lit(0).alias("h1"), F.lit(0).alias("h2")).limit(0)))
        for level in range(1, 1 + (top or 0)):
            named.put(signed(by_height.where(F.col("level") == level), named.all))
        return named.all
    now = rounds(own.select("state", F.col("e").alias("h1"), F.xxhash64(F.lit(5), "e").alias("h2")))
    n = now.select(*_SET).distinct().count()
    while True:
        now = rounds(signed(own.join(now, "state").select("state", F.xxhash64("e", "h1").alias("e")), now))
        more = now.select(*_SET).distinct().count()
        if more == n:
            return now
        n = more


def minimize(t: ArcTable, pairs: bool = False, delta: float = FINE_DELTA) -> ArcTable:
    """The least deterministic table with the same strings and weights; the table has to be deterministic."""
    _need_pairs(t, "minimization", pairs)
    _deterministic(t, "minimization")
    t, total = t.connect(), 0.0
    if not _unweighted(t):
        t, total = t.without_total()
    rounds = Rounds(t.arcs.sparkSession)
    named = rounds(classes(rounds, t, delta))
    first = named.groupBy(*_SET).agg(F.min("state").alias("first"))
    to = rounds(named.join(first, _SET).select("state", "first"))
    begins = t.states.where("is_start").join(to, "state").select(F.col("first").alias("state"), F.lit(True).alias("begins"))
    states = t.states.join(to.where("state = first").select("state"), "state").join(begins, "state", "left")
    arcs = t.arcs.join(to.where("state = first").select(F.col("state").alias("src")), "src", "left_semi").join(to.toDF("dst", "end"), "dst")
    states, arcs = rounds.done(states.select("state", F.coalesce("begins", F.lit(False)).alias("is_start"), "final_weight"), arcs.select("src", *_LABELS, "weight", F.col("end").alias("dst")))
    made = ArcTable(states, arcs, t.semiring)
    return made._times_all(total) if total else made


def optimize(t: ArcTable, budget: int = BUDGET, pairs: bool = False) -> ArcTable:
    """Epsilons removed, determinized, minimized."""
    return minimize(determinize(t.rmepsilon().connect(), budget, pairs), pairs)


def _side_by_side(a: ArcTable, b: ArcTable) -> tuple[ArcTable, Column]:
    """Both tables in one, a's states even and b's odd."""
    def moved(t: ArcTable, k: int) -> tuple[DataFrame, DataFrame]:
        put = lambda c: (F.col(c) * 2 + k).alias(c)
        return t.states.select(put("state"), "is_start", "final_weight"), t.arcs.select(put("src"), *_LABELS, "weight", put("dst"))

    (s, x), (r, y) = moved(a, 0), moved(b, 1)
    return ArcTable(s.unionByName(r), x.unionByName(y), a.semiring)


def counterexample(a: ArcTable, b: ArcTable, delta: float = FINE_DELTA) -> DataFrame:
    """(labels, weight_a, weight_b): a shortest string that the two deterministic acceptors read differently; no row if they are equivalent.

    Classes tell which pairs of states differ; only such pairs are walked.
    """
    same(a, b)
    for t in (a, b):
        _need_pairs(t, "a comparison", False)
        _deterministic(t, "a comparison")
    (a, weight_a), (b, weight_b) = ((t, 0.0) if _unweighted(t) else t.without_total() for t in (a.connect(), b.connect()))
    rounds = Rounds(a.arcs.sparkSession)
    both = _side_by_side(a, b)
    both = ArcTable(rounds(both.states), rounds(both.arcs), a.semiring)
    named = rounds(classes(rounds, both, delta))
    side = lambda k, p: both.arcs.where(F.pmod("src", F.lit(2)) == k).select(F.col("src").alias(p), "ilabel", F.col("weight").alias(f"w_{p}"), F.col("dst").alias(f"to_{p}"))
    left, right = side(0, "p"), side(1, "q")
    name = lambda p: named.select(F.col("state").alias(p), F.struct(*_SET).alias(f"n_{p}"))
    end = lambda p: both.states.where("final_weight is not null").select(F.col("state").alias(p), F.col("final_weight").alias(f"f_{p}"))
    start = lambda k, p: both.states.where("is_start").where(F.pmod("state", F.lit(2)) == k).agg(F.max("state").alias(p)).withColumn("k", F.lit(0))

    def differing(df: DataFrame) -> DataFrame:
        marked = df.join(name("p"), "p", "left").join(name("q"), "q", "left")
        off = ~F.col("n_p").eqNullSafe(F.col("n_q")) | (F.abs(F.col("a") - F.col("b")) > delta)
        return marked.where(off).select("p", "q", "a", "b", "labels")

    first = start(0, "p").join(start(1, "q"), "k").select("p", "q", F.lit(weight_a).alias("a"), F.lit(weight_b).alias("b"), F.array().cast("array<long>").alias("labels"))
    seen = Growing(rounds, ["p", "q"], differing(first))
    none = seen.new.select("labels", F.lit(0.0).alias("weight_a"), F.lit(0.0).alias("weight_b")).limit(0)
    while seen.n_new:
        ends = seen.new.join(end("p"), "p", "left").join(end("q"), "q", "left").select("labels", (F.col("a") + F.col("f_p")).alias("weight_a"), (F.col("b") + F.col("f_q")).alias("weight_b"))
        off = ends.where(F.col("weight_a").isNull() != F.col("weight_b").isNull()).unionByName(ends.where(F.abs(F.col("weight_a") - F.col("weight_b")) > delta))
        off, n_off = rounds.counted(off.orderBy("labels").limit(1))
        if n_off:
            return rounds.done(off)[0]
        on_left = seen.new.join(left, "p")
        fresh = on_left.join(right, ["q", "ilabel"], "left").select("to_p", "to_q", "a", "b", "labels", "ilabel", "w_p", "w_q")
        alone = seen.new.join(right, "q").join(left, ["p", "ilabel"], "left_anti").select(F.lit(None).cast("long").alias("to_p"), "to_q", "a", "b", "labels", "ilabel", F.lit(None).cast("double").alias("w_p"), "w_q")
        stepped = fresh.unionByName(alone).select(F.col("to_p").alias("p"), F.col("to_q").alias("q"), (F.col("a") + F.col("w_p")).alias("a"), (F.col("b") + F.col("w_q")).alias("b"), F.concat("labels", F.array("ilabel")).alias("labels"))
        one = differing(stepped).groupBy("p", "q").agg(F.min(F.struct("labels", "a", "b")).alias("r")).select("p", "q", "r.a", "r.b", "r.labels")
        gone = seen.all.select(F.col("p").alias("p0"), F.col("q").alias("q0"))
        seen.put(one.join(gone, F.col("p").eqNullSafe(F.col("p0")) & F.col("q").eqNullSafe(F.col("q0")), "left_anti"))
    return rounds.done(none)[0]


def equivalent(a: ArcTable, b: ArcTable, delta: float = FINE_DELTA) -> bool:
    """Whether two deterministic acceptors give the same strings the same weights."""
    (empty_a, empty_b) = (t.connect().states.isEmpty() for t in (a, b))
    if empty_a or empty_b:
        return empty_a and empty_b
    return counterexample(a, b, delta).isEmpty()


def renumbering(a: ArcTable, b: ArcTable, delta: float = FINE_DELTA) -> DataFrame | None:
    """(state, other): how the states of a are numbered in b, if the tables differ by numbers only; else None.

    Both are walked together from their starts along equal arcs, which have to be different
    from each other at each state; states that are not reached are not compared.
    """
    same(a, b)
    key = [*_LABELS, "w"]
    level = lambda t: t.arcs.withColumn("w", _level(F.col("weight"), delta))
    rounds = Rounds(a.arcs.sparkSession)
    left, right = rounds(level(a).select(F.col("src").alias("p"), *key, F.col("dst").alias("to_p"))), rounds(level(b).select(F.col("src").alias("q"), *key, F.col("dst").alias("to_q")))
    for t, c in ((left, "p"), (right, "q")):
        if not t.groupBy(c, *key).count().where("count > 1").isEmpty():
            raise ArgumentError("equal arcs leave a state: the walk has no choice that is right")
    start = lambda t, p: t.states.where("is_start").agg(F.max("state").alias(p)).where(f"{p} is not null").withColumn("k", F.lit(0))
    pairs = Growing(rounds, ["p", "q"], start(a, "p").join(start(b, "q"), "k").select("p", "q"))
    reach = lambda t: t._reached(rounds, t.states.where("is_start"))
    while pairs.n_new:
        met = pairs.new.join(left, "p").join(right, ["q", *key])
        n_left, n_right, n_met = pairs.new.join(left, "p").count(), pairs.new.join(right, "q").count(), met.count()
        if not n_left == n_right == n_met:
            return None
        pairs.add(met.select(F.col("to_p").alias("p"), F.col("to_q").alias("q")).distinct())
    ends = lambda t, p: t.states.select(F.col("state").alias(p), _level(F.col("final_weight"), delta).alias(f"f_{p}"))
    off = pairs.all.join(ends(a, "p"), "p").join(ends(b, "q"), "q").where(~F.col("f_p").eqNullSafe(F.col("f_q")))
    n = pairs.all.count()
    one = all(pairs.all.select(c).distinct().count() == n for c in ("p", "q"))
    if not off.isEmpty() or not one or reach(a).count() != n or reach(b).count() != n:
        return None
    return rounds.done(pairs.all.toDF("state", "other"))[0]


def isomorphic(a: ArcTable, b: ArcTable, delta: float = FINE_DELTA) -> bool:
    return renumbering(a, b, delta) is not None
