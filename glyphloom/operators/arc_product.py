"""Products of arc tables: composition with its filters, intersection and difference.

States of a product are pairs that are reached from the pair of starts, with the filter's
state.  A round joins the pairs that are new with the arcs of both tables on state and label;
what it finds is written once.  Pairs get numbers at the end, so no code of two numbers in
one can collide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..semiring import same
from .arcs import ArcTable
from .rounds import Growing, Rounds, numbered

_PAIR, _NEXT = ["left", "right", "filter"], ["left2", "right2", "filter2"]

#: What each filter allows: moves of both on a label, of both silently, of the left or right alone; each with the
#: filter's states that allow it and the state that follows.  All but trivial and null give each pair of paths once.
FILTERS = {
    "sequence": {"left": ((0,), 0), "right": ((0, 1), 1)},
    "alt_sequence": {"right": ((0,), 0), "left": ((0, 1), 1)},
    "match": {"silent": ((0,), 0), "left": ((0, 1), 1), "right": ((0, 2), 2)},
    "trivial": {"silent": ((0,), 0), "left": ((0,), 0), "right": ((0,), 0)},
    "null": {"silent": ((0,), 0)},
}


def _moves(new: DataFrame, left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], rules: dict) -> DataFrame:
    """Arcs that leave new pairs: (pair, ilabel, olabel, weight, next pair).  Each side's arcs: those with a label, and the silent ones."""
    row = lambda i, o, w, a, b, f: [*_PAIR, i.alias("ilabel"), o.alias("olabel"), w.alias("weight"), a.alias("left2"), b.alias("right2"), F.lit(f).alias("filter2")]
    silent, c = F.lit(0).cast("long"), F.col
    (left_loud, left_silent), (right_loud, right_silent) = left, right
    loud = new.join(left_loud, "left").join(right_loud, (c("right") == c("b_src")) & (c("ao") == c("bi")))
    found = [loud.select(*row(c("ai"), c("bo"), c("aw") + c("bw"), c("a_dst"), c("b_dst"), 0))]
    if "silent" in rules:
        allowed, then = rules["silent"]
        both = new.where(c("filter").isin(*allowed)).join(left_silent, "left").join(right_silent, c("right") == c("b_src"))
        found.append(both.select(*row(c("ai"), c("bo"), c("aw") + c("bw"), c("a_dst"), c("b_dst"), then)))
    if "left" in rules:
        allowed, then = rules["left"]
        found.append(new.where(c("filter").isin(*allowed)).join(left_silent, "left").select(*row(c("ai"), silent, c("aw"), c("a_dst"), c("right"), then)))
    if "right" in rules:
        allowed, then = rules["right"]
        alone = new.where(c("filter").isin(*allowed)).join(right_silent, c("right") == c("b_src"))
        found.append(alone.select(*row(silent, c("bo"), c("bw"), c("left"), c("b_dst"), then)))
    return reduce(DataFrame.unionByName, found)


def _numbered_table(rounds: Rounds, pairs: DataFrame, arcs: DataFrame, first: DataFrame, finals: DataFrame, ring) -> tuple[ArcTable, DataFrame]:
    """Pairs to numbers: the table, and (state, left, right, filter)."""
    number = rounds(numbered(rounds, pairs.select(*_PAIR), "state"))
    match = lambda cols: reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"n_{b}")) for a, b in zip(cols, _PAIR)])
    n = number.select(F.col("state").alias("n"), *[F.col(c).alias(f"n_{c}") for c in _PAIR])
    from_ = arcs.join(n, match(_PAIR)).select(F.col("n").alias("src"), "ilabel", "olabel", "weight", *_NEXT)
    to = from_.join(n, match(_NEXT)).select("src", "ilabel", "olabel", "weight", F.col("n").alias("dst"))
    ends = rounds(finals.join(n, match(_PAIR)).select(F.col("n").alias("state"), "final_weight"))
    starts = rounds(first.join(n, match(_PAIR)).select(F.col("n").alias("state"), F.lit(True).alias("is_start")))
    states = number.select("state").join(starts, "state", "left").join(ends, "state", "left").select("state", F.coalesce("is_start", F.lit(False)).alias("is_start"), "final_weight")
    arcs, states, number = rounds.done(to, states, number)
    return ArcTable(states, arcs, ring), number


def _starts(a: ArcTable, b: ArcTable) -> DataFrame:
    """The pair of starts: one row at most."""
    one = lambda t, name: t.states.where("is_start").agg(F.max("state").alias(name)).where(f"{name} is not null").withColumn("k", F.lit(0))
    return one(a, "left").join(one(b, "right"), "k").select("left", "right", F.lit(0).alias("filter"))


def compose_pairs(a: ArcTable, b: ArcTable, compose_filter: str = "auto") -> tuple[ArcTable, DataFrame]:
    """The composition of two tables, unconnected, and what pair each of its states is."""
    ring = same(a, b)
    name = "sequence" if compose_filter == "auto" else compose_filter
    if name not in FILTERS:
        raise ArgumentError(f"unknown compose filter: {compose_filter}")
    rounds = Rounds(a.arcs.sparkSession)
    # apart, since the few silent arcs are sent to all tasks where many pairs meet at a state
    parts = lambda arcs, label: (rounds(arcs.where(f"{label} <> 0")), rounds(arcs.where(f"{label} = 0")))
    left = parts(a.arcs.select(F.col("src").alias("left"), F.col("ilabel").alias("ai"), F.col("olabel").alias("ao"), F.col("weight").alias("aw"), F.col("dst").alias("a_dst")), "ao")
    right = parts(b.arcs.select(F.col("src").alias("b_src"), F.col("ilabel").alias("bi"), F.col("olabel").alias("bo"), F.col("weight").alias("bw"), F.col("dst").alias("b_dst")), "bi")
    first = rounds(_starts(a, b))
    seen = Growing(rounds, _PAIR, first)
    arcs = Growing(rounds, [], _moves(seen.new, left, right, FILTERS[name]))
    while seen.add(arcs.new.select(*[F.col(c).alias(p) for c, p in zip(_NEXT, _PAIR)]).distinct()):
        if not arcs.put(_moves(seen.new, left, right, FILTERS[name])):
            break
    pairs = seen.all
    end = lambda t, state, w: rounds(t.states.where("final_weight is not null").select(F.col("state").alias(state), F.col("final_weight").alias(w)))
    finals = pairs.join(end(a, "left", "aw"), "left").join(end(b, "right", "bw"), "right").select(*_PAIR, (F.col("aw") + F.col("bw")).alias("final_weight"))
    return _numbered_table(rounds, pairs, arcs.all, first, finals, ring)


def compose(a: ArcTable, b: ArcTable, compose_filter: str = "auto", connect: bool = True) -> ArcTable:
    made = compose_pairs(a, b, compose_filter)[0]
    return made.connect() if connect else made


def _acceptor(t: ArcTable, what: str) -> None:
    if not t.arcs.where("ilabel <> olabel").isEmpty():
        raise ArgumentError(f"{what} needs acceptors")


def intersect(a: ArcTable, b: ArcTable, compose_filter: str = "auto", connect: bool = True) -> ArcTable:
    for t in (a, b):
        _acceptor(t, "intersect")
    return compose(a, b, compose_filter, connect)


def difference(a: ArcTable, b: ArcTable, connect: bool = True) -> ArcTable:
    """The strings of a that b lacks; b an unweighted deterministic acceptor without epsilons.

    b's side of a pair is null once b has no arc for what a reads.
    """
    ring = same(a, b)
    _acceptor(a, "difference")
    _acceptor(b, "difference")
    if not b.arcs.where("ilabel = 0 or weight <> 0").isEmpty() or not b.states.where("final_weight <> 0").isEmpty() or not b.arcs.groupBy("src", "ilabel").count().where("count > 1").isEmpty():
        raise ArgumentError("what is subtracted has to be an unweighted deterministic acceptor without epsilons")
    rounds = Rounds(a.arcs.sparkSession)
    left = rounds(a.arcs.select(F.col("src").alias("left"), "ilabel", "weight", F.col("dst").alias("left2")))
    right = rounds(b.arcs.select(F.col("src").alias("b_src"), F.col("ilabel").alias("bi"), F.col("dst").alias("b_dst")))
    start = lambda t, name: t.states.where("is_start").agg(F.max("state").alias(name)).withColumn("k", F.lit(0))
    first = rounds(start(a, "left").where("left is not null").join(start(b, "right"), "k", "left").select("left", "right", F.lit(0).alias("filter")))

    def moves(new: DataFrame) -> DataFrame:
        found = new.join(left, "left").join(right, (F.col("right") == F.col("b_src")) & (F.col("ilabel") == F.col("bi")), "left")
        stays: Column = F.when(F.col("ilabel") == 0, F.col("right")).otherwise(F.col("b_dst"))
        return found.select(*_PAIR, "ilabel", F.col("ilabel").alias("olabel"), "weight", "left2", stays.alias("right2"), F.lit(0).alias("filter2"))

    # a null side is -1 while pairs are compared
    shown = lambda df, *cols: df.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in cols})
    seen = Growing(rounds, _PAIR, shown(first, "right"))
    arcs = Growing(rounds, [], shown(moves(seen.new), "right2"))
    while seen.add(arcs.new.select(*[F.col(c).alias(p) for c, p in zip(_NEXT, _PAIR)]).distinct()):
        if not arcs.put(shown(moves(seen.new), "right2")):
            break
    pairs = seen.all
    ends = rounds(a.states.where("final_weight is not null").select(F.col("state").alias("left"), "final_weight"))
    gone = rounds(b.states.where("final_weight is not null").select(F.col("state").alias("right")))
    finals = pairs.join(ends, "left").join(gone, "right", "left_anti").select(*_PAIR, "final_weight")
    made = _numbered_table(rounds, pairs, arcs.all, shown(first, "right"), finals, ring)[0]
    return made.connect() if connect else made
