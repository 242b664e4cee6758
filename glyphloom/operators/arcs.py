"""Machines as tables: states (state, is_start, final_weight) and arcs (src, ilabel, olabel, weight, dst).

For graphs that grow with data.  Every fixpoint is a loop of joins whose rounds are cut
through the shared checkpoint folder; only counts come to the driver.  In each round new
rows alone are joined, so a round costs what it finds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError, OperationError
from ..semiring import DELTA, FINE_DELTA, INFINITY, TROPICAL, Semiring, same, semiring
from .machine import Machine
from .rounds import Growing, Improving, Rounds, chains, numbered

STATES = "state long, is_start boolean, final_weight double"
ARCS = "src long, ilabel long, olabel long, weight double, dst long"
PATIENCE = 256  # rounds after which mass in cycles must have shrunk


class ArcTable:
    def __init__(self, states: DataFrame, arcs: DataFrame, ring: Semiring | str = TROPICAL):
        self.states = states.select("state", "is_start", "final_weight")
        self.arcs = arcs.select("src", "ilabel", "olabel", "weight", "dst")
        self.semiring = semiring(ring)

    def _with(self, states: DataFrame | None = None, arcs: DataFrame | None = None) -> ArcTable:
        return ArcTable(self.states if states is None else states, self.arcs if arcs is None else arcs, self.semiring)

    # -- to and from the driver

    @classmethod
    def of_machine(cls, spark: SparkSession, m: Machine) -> ArcTable:
        states = [(s, s == m.start, m.finals.get(s)) for s in m.states()]
        arcs = [(s, a.ilabel, a.olabel, float(a.weight), a.to) for s, a in m.all_arcs()]
        return cls(spark.createDataFrame(states, STATES), spark.createDataFrame(arcs, ARCS), m.semiring)

    def to_machine(self, most: int = 1_000_000) -> Machine:
        """On the driver; at most so many arcs."""
        arcs = self.arcs.orderBy("src", "ilabel", "olabel", "dst", "weight").limit(most + 1).collect()
        if len(arcs) > most:
            raise OperationError(f"more than {most} arcs")
        states = self.states.orderBy("state").collect()
        number = {r.state: k for k, r in enumerate(states)}
        m = Machine(self.semiring)
        m.add_states(len(states))
        for r in states:
            if r.is_start:
                m.set_start(number[r.state])
            if r.final_weight is not None:
                m.set_final(number[r.state], r.final_weight)
        for r in arcs:
            m.add_arc(number[r.src], r.ilabel, r.olabel, r.weight, number[r.dst])
        return m

    # -- counts and tests

    def counts(self) -> DataFrame:
        """state, n_arcs, n_input_epsilons, n_output_epsilons."""
        n = self.arcs.groupBy(F.col("src").alias("state")).agg(F.count(F.lit(1)).alias("n_arcs"), F.count_if(F.col("ilabel") == 0).alias("n_input_epsilons"), F.count_if(F.col("olabel") == 0).alias("n_output_epsilons"))
        return self.states.select("state").join(n, "state", "left").na.fill(0)

    def verify(self) -> bool:
        """One start at most, no label below 0, no arc to or from a state that is missing."""
        ends = self.arcs.select(F.explode(F.array("src", "dst")).alias("state"))
        bad = self.arcs.where("ilabel < 0 or olabel < 0")
        return self.states.where("is_start").limit(2).count() <= 1 and ends.join(self.states, "state", "left_anti").isEmpty() and bad.isEmpty()

    def properties(self) -> dict[str, bool]:
        a, s = self.arcs, self.states
        row = a.agg(F.coalesce(F.bool_and(F.col("ilabel") == F.col("olabel")), F.lit(True)), F.coalesce(F.bool_and(F.col("weight") == 0), F.lit(True)), F.coalesce(F.bool_and((F.col("ilabel") != 0) | (F.col("olabel") != 0)), F.lit(True))).first()
        several = a.groupBy("src", "ilabel").count().where("count > 1").isEmpty()
        finals = s.where("final_weight is not null and final_weight <> 0").isEmpty()
        return {"acceptor": row[0], "unweighted": row[1] and finals, "epsilon_free": row[2], "input_deterministic": several, "acyclic": self.order() is not None}

    def equal(self, other: ArcTable, delta: float = DELTA) -> bool:
        same(self, other)
        key = ["src", "ilabel", "olabel", "dst"]
        a, b = self.arcs.groupBy(*key).agg(F.sort_array(F.collect_list("weight")).alias("w")), other.arcs.groupBy(*key).agg(F.sort_array(F.collect_list("weight")).alias("v"))
        near = F.forall(F.zip_with("w", "v", lambda x, y: F.coalesce((x == y) | (F.abs(x - y) <= delta), F.lit(False))), lambda x: x)
        off = a.join(b, key, "full").where("w is null or v is null").isEmpty() and a.join(b, key).where(~near).isEmpty()
        s = self.states.join(other.states.toDF("state", "is2", "f2"), "state", "full").where(~(F.col("is_start").eqNullSafe(F.col("is2")) & (F.col("final_weight").eqNullSafe(F.col("f2")) | F.coalesce(F.abs(F.col("final_weight") - F.col("f2")) <= delta, F.lit(False)))))
        return off and s.isEmpty()

    # -- arcs

    def project(self, side: str) -> ArcTable:
        if side not in ("input", "output"):
            raise ArgumentError(f"no side of a relation: {side}")
        c = F.col("ilabel" if side == "input" else "olabel")
        return self._with(arcs=self.arcs.select("src", c.alias("ilabel"), c.alias("olabel"), "weight", "dst"))

    def invert(self) -> ArcTable:
        return self._with(arcs=self.arcs.select("src", F.col("olabel").alias("ilabel"), F.col("ilabel").alias("olabel"), "weight", "dst"))

    def reverse(self) -> ArcTable:
        """Arcs turned round; a new start -1 leads to the finals."""
        arcs = self.arcs.select(F.col("dst").alias("src"), "ilabel", "olabel", "weight", F.col("src").alias("dst"))
        ends = self.states.where("final_weight is not null").select(F.lit(-1).cast("long").alias("src"), F.lit(0).cast("long").alias("ilabel"), F.lit(0).cast("long").alias("olabel"), F.col("final_weight").alias("weight"), F.col("state").alias("dst"))
        first = self.states.limit(1).select(F.lit(-1).cast("long").alias("state"), F.lit(True).alias("is_start"), F.lit(None).cast("double").alias("final_weight"))
        states = self.states.select("state", F.lit(False).alias("is_start"), F.when(F.col("is_start"), 0.0).alias("final_weight"))
        return self._with(states.unionByName(first), arcs.unionByName(ends))

    def relabel(self, ipairs: DataFrame | None = None, opairs: DataFrame | None = None) -> ArcTable:
        """Pairs are tables (old, new)."""
        if ipairs is None and opairs is None:
            raise ArgumentError("no pairs of labels")
        arcs = self.arcs
        for pairs, side in ((ipairs, "ilabel"), (opairs, "olabel")):
            if pairs is not None:
                arcs = arcs.join(pairs.select(F.col("old").alias(side), "new"), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        return self._with(arcs=arcs)

    def encode(self, labels: bool = True, weights: bool = False) -> tuple[ArcTable, DataFrame]:
        """Arcs with packed labels and the table (code, ...) to decode them."""
        key = ["ilabel"] + ["olabel"] * labels + ["weight"] * weights
        rounds = Rounds(self.arcs.sparkSession)
        (codes,) = rounds.done(numbered(rounds, self.arcs.select(*key), "code", 1))
        coded = self.arcs.join(codes, key)
        arcs = coded.select("src", F.col("code").alias("ilabel"), (F.col("code") if labels else F.col("olabel")).alias("olabel"), (F.lit(0.0) if weights else F.col("weight")).alias("weight"), "dst")
        return self._with(arcs=arcs), codes

    def decode(self, codes: DataFrame) -> ArcTable:
        kept = codes.select(F.col("code").alias("k"), *[F.col(c).alias(f"old_{c}") for c in codes.columns if c != "code"])
        joined = self.arcs.join(kept, F.col("ilabel") == F.col("k"))
        pick = lambda c: F.col(f"old_{c}" if f"old_{c}" in kept.columns else c).alias(c)
        return self._with(arcs=joined.select("src", pick("ilabel"), pick("olabel"), pick("weight"), "dst"))

    def arc_sum(self) -> ArcTable:
        return self._with(arcs=self.semiring.sums(self.arcs, ["src", "ilabel", "olabel", "dst"]))

    def arc_unique(self) -> ArcTable:
        return self._with(arcs=self.arcs.distinct())

    def superfinal(self) -> ArcTable:
        """One final state, -2, reached by epsilon arcs."""
        end = F.lit(-2).cast("long")
        more = self.states.where("final_weight is not null").select(F.col("state").alias("src"), F.lit(0).cast("long").alias("ilabel"), F.lit(0).cast("long").alias("olabel"), F.col("final_weight").alias("weight"), end.alias("dst"))
        states = self.states.withColumn("final_weight", F.lit(None).cast("double")).unionByName(self.states.limit(1).select(end.alias("state"), F.lit(False).alias("is_start"), F.lit(0.0).alias("final_weight")))
        return self._with(states, self.arcs.unionByName(more))

    def delete_states(self, gone: DataFrame) -> ArcTable:
        """Without some states (a column `state`) and all arcs at them."""
        g = gone.select("state").distinct()
        arcs = self.arcs.join(g.toDF("src"), "src", "left_anti").join(g.toDF("dst"), "dst", "left_anti")
        return self._with(self.states.join(g, "state", "left_anti"), arcs)

    # -- fixpoints

    def _steps(self, backward: bool = False) -> DataFrame:
        """(u, v, w, n): one row a pair of states, parallel arcs added."""
        u, v = ("dst", "src") if backward else ("src", "dst")
        steps = self.semiring.sums(self.arcs.select(F.col(u).alias("u"), F.col(v).alias("v"), F.col("weight").alias("w")), ["u", "v"], "w")
        return steps.select("u", "v", "w", F.lit(1).cast("long").alias("n"))

    def _reached(self, rounds: Rounds, start: DataFrame, backward: bool = False) -> DataFrame:
        """States that arcs lead to from `start`, itself included; chains of states in a few rounds."""
        steps = rounds(self._steps(backward))
        short = chains(rounds, steps, start)
        core = steps if short is None else short[0]
        seen = Growing(rounds, ["state"], start.select("state").distinct())
        while seen.add(seen.new.join(core, seen.new["state"] == core["u"]).select(F.col("v").alias("state")).distinct()):
            pass
        inside = [] if short is None else [short[1].join(seen.all.withColumnRenamed("state", "u"), "u", "left_semi").select("state")]
        return rounds(seen.all.unionByName(inside[0])) if inside else seen.all

    def connect(self) -> ArcTable:
        """States and arcs on paths from the start to a final."""
        rounds = Rounds(self.arcs.sparkSession)
        fore = self._reached(rounds, self.states.where("is_start"))
        aft = self._reached(rounds, self.states.where("final_weight is not null"), backward=True)
        (keep,) = rounds.done(fore.join(aft, "state"))
        arcs = self.arcs.join(keep.toDF("src"), "src", "left_semi").join(keep.toDF("dst"), "dst", "left_semi")
        return self._with(self.states.join(keep, "state", "left_semi"), arcs)

    def order(self) -> DataFrame | None:
        """(state, level): the longest way to each state in arcs; None if there is a cycle."""
        rounds = Rounds(self.arcs.sparkSession)
        steps = rounds(self.arcs.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct().select("u", "v", F.lit(0.0).alias("w"), F.lit(1).cast("long").alias("n")))
        short = chains(rounds, steps, self.states.limit(0))
        core = rounds((steps if short is None else short[0]).groupBy("u", "v").agg(F.max("n").alias("n")))
        ways = rounds(core.groupBy(F.col("v").alias("state")).agg(F.count(F.lit(1)).alias("ways")))
        states = self.states.select("state").distinct()
        outer = states if short is None else states.join(short[1], "state", "left_anti")
        free = Growing(rounds, ["state"], outer.join(ways, "state", "left_anti").select("state", F.lit(0).cast("long").alias("level")))
        sent = Growing(rounds, [], ways.select("state", F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("level")).limit(0))
        while free.n_new:
            more = free.new.join(core, free.new["state"] == core["u"]).groupBy(F.col("v").alias("state")).agg(F.count(F.lit(1)).alias("gone"), F.max(F.col("level") + F.col("n")).alias("level"))
            if not sent.put(more):
                break
            all_of = sent.all.join(sent.new.select("state"), "state", "left_semi").groupBy("state").agg(F.sum("gone").alias("gone"), F.max("level").alias("level"))
            free.put(all_of.join(ways, "state").where("gone = ways").select("state", "level"))
        levels = free.all
        if short is not None:
            levels = levels.unionByName(short[1].join(free.all.withColumnRenamed("state", "u"), "u").select("state", (F.col("level") + F.col("n")).alias("level")))
        (levels,) = rounds.done(levels.select("state", F.col("level").cast("int").alias("level")))
        return levels if levels.count() == states.count() else None

    def topsort(self) -> ArcTable:
        """States numbered along the arcs; a cyclic table as it is."""
        order = self.order()
        if order is None:
            return self
        # places by range partitions of (level, state) and offsets of partitions: no window spans a level
        rounds = Rounds(self.arcs.sparkSession)
        number = numbered(rounds, order.repartitionByRange("level", "state").sortWithinPartitions("level", "state"), "new", distinct=False).select("state", "new")
        (number,) = rounds.done(number)
        states = self.states.join(number, "state").select(F.col("new").alias("state"), "is_start", "final_weight")
        arcs = self.arcs.join(number.toDF("src", "a"), "src").join(number.toDF("dst", "b"), "dst")
        return self._with(states, arcs.select(F.col("a").alias("src"), "ilabel", "olabel", "weight", F.col("b").alias("dst")))

    def shortestdistance(self, backward: bool = False, delta: float = FINE_DELTA) -> DataFrame:
        """(state, distance) of the states that are reached.

        tropical: rounds in which only improved states send on; a negative cycle is an error.
        log: rounds in which only the mass that is new travels on.  Without cycles that ends by
        itself; with cycles where no more than delta^2 of any state's mass is under way, and it is
        an error where that mass does not shrink.  Chains of states are one step.
        """
        rounds = Rounds(self.arcs.sparkSession)
        start = self.states.where("final_weight is not null").select("state", F.col("final_weight").alias("distance")) if backward else self.states.where("is_start").select("state", F.lit(0.0).alias("distance"))
        steps = rounds(self._steps(backward))
        short = chains(rounds, steps, start)
        core = rounds(self.semiring.sums((steps if short is None else short[0]).select("u", "v", "w"), ["u", "v"], "w"))
        step = lambda new: new.join(core, new["state"] == core["u"]).select(F.col("v").alias("state"), (F.col("distance") + F.col("w")).alias("distance"))
        known = self._spread(rounds, ["state"], start, "distance", step, delta)
        if short is not None:
            known = known.unionByName(short[1].join(known.withColumnRenamed("state", "u"), "u").select("state", (F.col("distance") + F.col("w")).alias("distance")))
        return rounds.done(known)[0]

    def _spread(self, rounds: Rounds, keys: list[str], first: DataFrame, weight: str, step, delta: float) -> DataFrame:
        """Weights of all ways from the rows of `first`, which `step` carries on by an arc."""
        if self.semiring.has_best_path:
            best = Improving(rounds, keys, first.groupBy(*keys).agg(F.min(weight).alias(weight)), [weight], FINE_DELTA)
            for _ in range(self.states.count() + 1):
                if not best.add(step(best.new).groupBy(*keys).agg(F.min(weight).alias(weight))):
                    return best.best
            raise OperationError("least weights do not converge: a negative cycle")
        total = now = rounds(self.semiring.sums(first, keys, weight))
        shares: list[float] = []
        while True:
            now = rounds(self.semiring.sums(step(now).where(F.col(weight) < INFINITY), keys, weight))
            had = total.withColumnRenamed(weight, "had")
            share = now.join(had, keys, "left").agg(F.max(F.when(F.col("had").isNull(), INFINITY).otherwise(F.col("had") - F.col(weight)))).first()[0]
            if share is None:
                return total
            total = rounds(self.semiring.sums(total.unionByName(now), keys, weight))
            # how large, in logarithms, the mass under way is against what has come
            if share < 2 * math.log(delta):
                return total
            shares = [] if share == INFINITY else [*shares, share]
            if len(shares) >= PATIENCE and shares[len(shares) // 2] - shares[-1] < 0.5:
                raise OperationError("sums over the paths of these cycles do not end, or hardly")

    def rmepsilon(self, delta: float = FINE_DELTA) -> ArcTable:
        """Without arcs that are epsilon on both sides; closures by the semiring, cycles included."""
        rounds = Rounds(self.arcs.sparkSession)
        silent = rounds(self.semiring.sums(self.arcs.where("ilabel = 0 and olabel = 0").select("src", "dst", "weight"), ["src", "dst"]).toDF("at", "next", "w"))
        step = lambda new: new.join(silent, "at").select("src", F.col("next").alias("at"), (F.col("d") + F.col("w")).alias("d"))
        own = self.states.select(F.col("state").alias("src"), F.col("state").alias("at"), F.lit(0.0).alias("d"))
        near = self._spread(rounds, ["src", "at"], own, "d", step, delta)
        loud = self.arcs.where("ilabel <> 0 or olabel <> 0").withColumnRenamed("src", "at")
        arcs = self.semiring.sums(near.join(loud, "at").select("src", "ilabel", "olabel", "dst", (F.col("d") + F.col("weight")).alias("weight")), ["src", "ilabel", "olabel", "dst"])
        ends = self.states.where("final_weight is not null").select(F.col("state").alias("at"), "final_weight")
        finals = self.semiring.sums(near.join(ends, "at").select(F.col("src").alias("state"), (F.col("d") + F.col("final_weight")).alias("final_weight")), ["state"], "final_weight")
        arcs, finals = rounds.done(arcs, finals)
        return self._with(self.states.drop("final_weight").join(finals, "state", "left").select("state", "is_start", "final_weight"), arcs)

    def push(self, to_final: bool = False, remove_total_weight: bool = False) -> ArcTable:
        """Weights moved towards the start, or the finals; paths keep theirs unless the total weight is removed."""
        potentials = self.shortestdistance(backward=not to_final)
        if not to_final:
            return self._shifted(potentials, True) if remove_total_weight else self.reweight(potentials)
        pushed = self.reweight(potentials, to_initial=False)
        if remove_total_weight:
            ends = pushed.states.where("final_weight is not null").select(F.lit(1).alias("all"), "final_weight")
            total = self.semiring.sums(ends, ["all"], "final_weight").first()
            pushed = pushed if total is None else pushed._times_all(-total["final_weight"], at_start=False)
        return pushed

    def without_total(self) -> tuple[ArcTable, float]:
        """Pushed to the start and without the total weight; and that weight."""
        potentials = self.shortestdistance(backward=True)
        total = self.states.where("is_start").join(potentials, "state").select("distance").first()
        return self._shifted(potentials, True), 0.0 if total is None else total["distance"]

    def reweight(self, potentials: DataFrame, to_initial: bool = True) -> ArcTable:
        """potentials (state, distance); arcs change by the difference of their ends, and the start's own is given back, so that paths keep their weights."""
        out = self._shifted(potentials, to_initial)
        first = self.states.where("is_start").join(potentials.where(F.abs("distance") < INFINITY), "state").select("distance").first()
        return out if first is None or not first["distance"] else out._times_all(first["distance"] * (1 if to_initial else -1))

    def _shifted(self, potentials: DataFrame, to_initial: bool) -> ArcTable:
        p = potentials.where(F.abs("distance") < INFINITY).select("state", "distance")
        arcs = self.arcs.join(p.toDF("src", "a"), "src", "left").join(p.toDF("dst", "b"), "dst", "left")
        moved = F.col("weight") + (F.col("b") - F.col("a") if to_initial else F.col("a") - F.col("b"))
        states = self.states.join(p, "state", "left")
        final = F.col("final_weight") + (-F.col("distance") if to_initial else F.col("distance"))
        return self._with(states.withColumn("final_weight", F.coalesce(final, "final_weight")), arcs.withColumn("weight", F.coalesce(moved, "weight")))

    def _times_all(self, weight: float, at_start: bool = True) -> ArcTable:
        """All paths heavier by a weight: at the arcs and final weight of the start, of a new start with copies of its arcs where arcs lead into it; or at the finals."""
        if not at_start:
            return self._with(self.states.withColumn("final_weight", F.col("final_weight") + weight))
        start = self.states.where("is_start").select("state")
        if self.arcs.join(start.toDF("dst"), "dst", "left_semi").isEmpty():
            mark = start.select(F.col("state").alias("src"), F.lit(True).alias("from_start"))
            arcs = self.arcs.join(mark, "src", "left").withColumn("weight", F.when(F.col("from_start"), F.col("weight") + weight).otherwise(F.col("weight")))
            return self._with(self.states.withColumn("final_weight", F.when(F.col("is_start"), F.col("final_weight") + weight).otherwise(F.col("final_weight"))), arcs)
        new = F.lit(self.states.agg(F.min("state")).first()[0] - 1).cast("long")
        first = self.states.where("is_start").select(new.alias("state"), F.lit(True).alias("is_start"), (F.col("final_weight") + weight).alias("final_weight"))
        ways = self.arcs.join(start.toDF("src"), "src", "left_semi").select(new.alias("src"), "ilabel", "olabel", (F.col("weight") + weight).alias("weight"), "dst")
        return self._with(self.states.withColumn("is_start", F.lit(False)).unionByName(first), self.arcs.unionByName(ways))

    def prune(self, weight: float) -> ArcTable:
        """Arcs on paths within `weight` of the best."""
        self.semiring.require_best_path("prune")
        fore, aft = self.shortestdistance().toDF("src", "f"), self.shortestdistance(backward=True).toDF("dst", "g")
        best = self.states.where("is_start").join(aft.toDF("state", "g"), "state").agg(F.min("g")).scalar()
        arcs = self.arcs.join(fore, "src").join(aft, "dst").where(F.col("f") + F.col("weight") + F.col("g") <= best + weight + 1e-9)
        states = self.states.join(fore.toDF("state", "f"), "state", "left").withColumn("final_weight", F.when(F.col("f") + F.col("final_weight") <= best + weight + 1e-9, F.col("final_weight")))
        return self._with(states, arcs).connect()

    def paths(self) -> DataFrame:
        """(ilabels, olabels, weight) of every path from the start to a final; a cycle on one is an error."""
        rounds, clean = Rounds(self.arcs.sparkSession), self.connect()
        clean = self._with(rounds(clean.states), rounds(clean.arcs))
        if clean.order() is None:
            raise OperationError("a cyclic table has endless paths")
        loud = lambda c, seen: F.when(F.col(c) == 0, F.col(seen)).otherwise(F.concat(F.col(seen), F.array(c)))
        none = F.array().cast("array<long>")
        now = clean.states.where("is_start").select("state", none.alias("ilabels"), none.alias("olabels"), F.lit(0.0).alias("total"))
        ends = rounds(clean.states.where("final_weight is not null").select("state", "final_weight"))
        found = Growing(rounds, [], now.select("ilabels", "olabels", F.col("total").alias("weight")).limit(0))
        now, left = rounds.counted(now)
        while left:  # ends, since there is no cycle
            found.put(now.join(ends, "state").select("ilabels", "olabels", (F.col("total") + F.col("final_weight")).alias("weight")))
            now, left = rounds.counted(now.join(clean.arcs, F.col("state") == F.col("src")).select(F.col("dst").alias("state"), loud("ilabel", "ilabels").alias("ilabels"), loud("olabel", "olabels").alias("olabels"), (F.col("total") + F.col("weight")).alias("total")))
        return rounds.done(found.all)[0]
