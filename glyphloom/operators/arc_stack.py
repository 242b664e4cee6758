"""Arc tables with parentheses: balanced ways, grammars that call each other, expansion.

parens is a table (push, pop) of labels.  A way counts if its parentheses balance.  Balanced
ways are found by summaries, so the depth of nesting has no bound: a stretch between a push
and its pop becomes one step over it once it is known to balance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OperationError
from .arcs import ArcTable
from .rounds import Growing, Improving, Rounds, numbered

BUDGET = 10_000_000


def _parts(rounds: Rounds, t: ArcTable, parens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain arcs, arcs that push (src, k, w, dst), arcs that pop."""
    pairs = rounds(parens.select(F.col("push").cast("long").alias("push"), F.col("pop").cast("long").alias("pop")).distinct())
    marks = pairs.select("push").toDF("ilabel").unionByName(pairs.select("pop").toDF("ilabel"))
    plain = rounds(t.arcs.join(marks, "ilabel", "left_anti"))
    row = lambda c: t.arcs.join(pairs, F.col("ilabel") == F.col(c)).select("src", F.col("push").alias("k"), F.col("weight").alias("w"), "dst")
    return plain, rounds(row("push")), rounds(row("pop"))


def balanced(t: ArcTable, parens: DataFrame) -> DataFrame:
    """(entry, state, distance): the least weight of balanced ways from the start, and from each state that a push leads to, to each state.

    Only entries that are reached are followed.  Rounds are semi-naive: new or cheaper ways go on
    over plain arcs and known steps, and new or cheaper steps carry on the ways that were known.
    """
    t.semiring.require_best_path("balanced ways")
    if not t.arcs.where("weight < 0").isEmpty():
        raise OperationError("balanced ways take no negative weights")
    rounds = Rounds(t.arcs.sparkSession)
    plain, opens, closes = _parts(rounds, t, parens)
    edges = rounds(plain.groupBy("src", "dst").agg(F.min("weight").alias("w")))
    start = t.states.where("is_start").select(F.col("state").alias("entry"), "state", F.lit(0.0).alias("distance"))
    ways = Improving(rounds, ["entry", "state"], start, ["distance"], 1e-9)
    steps = Improving(rounds, ["src", "dst"], edges.limit(0), ["w"], 1e-9)
    while ways.n_new or steps.n_new:
        over = lambda some, by: some.join(by, some["state"] == by["src"]).select("entry", F.col("dst").alias("state"), (F.col("distance") + F.col("w")).alias("distance"))
        new_ways, new_steps = ways.new.limit(0) if not ways.n_new else ways.new, steps.new
        found = [over(new_ways, edges), over(new_ways, steps.best), new_ways.join(opens, new_ways["state"] == opens["src"]).select(F.col("dst").alias("entry"), F.col("dst").alias("state"), F.lit(0.0).alias("distance"))]
        if steps.n_new:
            found.append(over(ways.best, new_steps))
        least = rounds(reduce(DataFrame.unionByName, found).groupBy("entry", "state").agg(F.min("distance").alias("distance")))
        done = new_ways.join(closes.toDF("state", "k", "w2", "dst"), "state").select("entry", "k", (F.col("distance") + F.col("w2")).alias("rest"), "dst")
        stepped = done.join(opens.toDF("src", "k", "w1", "entry"), ["entry", "k"]).groupBy("src", "dst").agg(F.min(F.col("w1") + F.col("rest")).alias("w"))
        steps.add(stepped)
        ways.add(least)
    return rounds.done(ways.best)[0]


def balanced_shortest(t: ArcTable, parens: DataFrame) -> DataFrame:
    """(state, weight): the least weight of a balanced way from the start to each final state."""
    from_start = balanced(t, parens).join(t.states.where("is_start").select(F.col("state").alias("entry")), "entry", "left_semi")
    ends = t.states.where("final_weight is not null").select("state", "final_weight")
    return from_start.join(ends, "state").select("state", (F.col("distance") + F.col("final_weight")).alias("weight"))


def replace(root: ArcTable, parts: dict[int, ArcTable]) -> tuple[ArcTable, DataFrame]:
    """A grammar as one table with parentheses: an arc whose output is a key of `parts` calls that table, which may call others or itself.

    A call pushes a mark of its own and returns by the same; a called table's ends meet in one
    state first, so calls and ends do not multiply.
    """
    rounds = Rounds(root.arcs.sparkSession)
    everyone = {None: root, **parts}
    states = reduce(DataFrame.unionByName, [x.states.withColumn("part", F.lit(k).cast("long")) for k, x in everyone.items()])
    arcs = rounds(reduce(DataFrame.unionByName, [x.arcs.withColumn("part", F.lit(k).cast("long")) for k, x in everyone.items()]).withColumn("part", F.coalesce("part", F.lit(-1).cast("long"))))
    states = rounds(states.withColumn("part", F.coalesce("part", F.lit(-1).cast("long"))))
    exits = states.where("part >= 0").select("part", F.lit(None).cast("long").alias("state")).distinct()
    number = rounds(numbered(rounds, states.select("part", "state").unionByName(exits), "n"))
    at = lambda c, name: number.where("state is not null").select("part", F.col("state").alias(c), F.col("n").alias(name))
    moved = rounds(arcs.join(at("src", "a"), ["part", "src"]).join(at("dst", "b"), ["part", "dst"]).select(F.col("a").alias("src"), "ilabel", "olabel", "weight", F.col("b").alias("dst")))
    called = F.col("olabel").isin([int(k) for k in parts]) if parts else F.lit(False)
    calls = moved.where(called)
    numbers = rounds(numbered(rounds, calls.select("olabel", "dst"), "k"))
    top = arcs.agg(F.max(F.greatest("ilabel", "olabel"))).first()[0] or 0
    push, pop = (F.lit(top + 1) + 2 * F.col("k")).cast("long"), (F.lit(top + 2) + 2 * F.col("k")).cast("long")
    begins = states.where("is_start and part >= 0").join(number, ["part", "state"]).select(F.col("part").alias("olabel"), F.col("n").alias("begin"))
    over = number.where("state is null").select(F.col("part").alias("olabel"), F.col("n").alias("exit"))
    row = lambda df, a, label, w, b: df.select(a.alias("src"), label.alias("ilabel"), label.alias("olabel"), w.alias("weight"), b.alias("dst"))
    c, zero = F.col, F.lit(0.0)
    pushes = row(calls.join(numbers, ["olabel", "dst"]).join(begins, "olabel"), c("src"), push, c("weight"), c("begin"))
    pops = row(numbers.join(over, "olabel"), c("exit"), pop, zero, c("dst"))
    ends = states.where("final_weight is not null and part >= 0").join(number, ["part", "state"]).select("part", "n", "final_weight").join(number.where("state is null").select("part", F.col("n").alias("exit")), "part")
    leave = row(ends, c("n"), F.lit(0).cast("long"), c("final_weight"), c("exit"))
    own = F.col("part") == -1
    new_states = number.join(states.where("state is not null"), ["part", "state"], "left").select(F.col("n").alias("state"), F.coalesce(own & c("is_start"), F.lit(False)).alias("is_start"), F.when(own, c("final_weight")).alias("final_weight"))
    made, new_states, parens = rounds.done(moved.where(~called).unionByName(pushes).unionByName(pops).unionByName(leave), new_states, numbers.select(push.alias("push"), pop.alias("pop")))
    return ArcTable(new_states, made, root.semiring), parens


def expand(t: ArcTable, parens: DataFrame, budget: int = BUDGET) -> ArcTable:
    """The table without parentheses: a state for each state and stack that is reached; more than `budget` of them are an error."""
    rounds = Rounds(t.arcs.sparkSession)
    plain, opens, closes = _parts(rounds, t, parens)
    key, nothing = ["state", "stack"], F.lit(0).cast("long")
    seen = Growing(rounds, key, t.states.where("is_start").select("state", F.array().cast("array<long>").alias("stack")))
    first, made, n = seen.new, None, 1

    def moves(new: DataFrame) -> DataFrame:
        still = new.join(plain, new["state"] == plain["src"]).select(*key, "ilabel", "olabel", "weight", "dst", F.col("stack").alias("then"))
        deeper = new.join(opens, new["state"] == opens["src"]).select(*key, nothing.alias("ilabel"), nothing.alias("olabel"), F.col("w").alias("weight"), "dst", F.concat("stack", F.array("k")).alias("then"))
        on_top = new.where(F.size("stack") > 0).withColumn("k", F.element_at("stack", -1)).withColumnRenamed("state", "src")
        back = on_top.join(closes, ["src", "k"]).select(F.col("src").alias("state"), "stack", nothing.alias("ilabel"), nothing.alias("olabel"), F.col("w").alias("weight"), "dst", F.slice("stack", 1, F.size("stack") - 1).alias("then"))
        return still.unionByName(deeper).unionByName(back)

    while seen.n_new:
        if made is None:
            made = Growing(rounds, [], moves(seen.new))
        elif not made.put(moves(seen.new)):
            break
        seen.add(made.new.select(F.col("dst").alias("state"), F.col("then").alias("stack")).distinct())
        n += seen.n_new
        if n > budget:
            raise OperationError(f"an expansion makes more than {budget} states")
    number = rounds(numbered(rounds, seen.all, "n"))
    if made is None:
        return ArcTable(t.states.limit(0), t.arcs.limit(0), t.semiring)
    arcs = made.all.join(number.toDF("state", "stack", "a"), key).join(number.toDF("dst", "then", "b"), ["dst", "then"]).select(F.col("a").alias("src"), "ilabel", "olabel", "weight", F.col("b").alias("dst"))
    ends = t.states.where("final_weight is not null").select("state", "final_weight")
    finals = number.where(F.size("stack") == 0).join(ends, "state").select("n", "final_weight")
    begin = first.join(number, key).select("n", F.lit(True).alias("begins"))
    states = number.select("n").join(finals, "n", "left").join(begin, "n", "left").select(F.col("n").alias("state"), F.coalesce("begins", F.lit(False)).alias("is_start"), "final_weight")
    states, arcs = rounds.done(states, arcs)
    return ArcTable(states, arcs, t.semiring).connect()
