"""Weighted relations as DataFrames: (istring, ostring, weight), one row a pair of strings.

Each operator of the algebra is an ordinary join, union, projection or aggregation, so
Catalyst plans it.  A side is broadcast only where it is built from a bounded literal on
the driver (`bounded`); other joins leave the choice to the planner's size estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, OperationError
from ..semiring import DELTA, FINE_DELTA, INFINITY, TROPICAL, Semiring, quantized, same, semiring

SCHEMA = "istring string, ostring string, weight double"
MOST_LITERALS = 50_000


class Relation:
    """An immutable weighted relation; equal pairs may occur in several rows until `merged`."""

    def __init__(self, df: DataFrame, ring: Semiring | str = TROPICAL, bounded: bool | int = False):
        self.df = df.select("istring", "ostring", F.col("weight").cast("double").alias("weight"))
        self.semiring, self.most = semiring(ring), MOST_LITERALS if bounded is True else int(bounded)

    # -- sources

    @classmethod
    def of_rows(cls, spark: SparkSession, rows, ring: Semiring | str = TROPICAL) -> Relation:
        """From strings or tuples (input[, output[, weight]]); '' is the empty string."""
        ring = semiring(ring)
        made = []
        for r in rows:
            r = (r,) if isinstance(r, str) else tuple(r)
            if not 1 <= len(r) <= 3:
                raise ArgumentError("a row has one to three fields")
            made.append((r[0], r[1] if len(r) > 1 else r[0], ring.weight(r[2] if len(r) > 2 else None)))
        return cls(spark.createDataFrame(made, SCHEMA), ring, bounded=len(made) if len(made) <= MOST_LITERALS else 0).merged()

    @classmethod
    def of_column(cls, df: DataFrame, column: str, ring: Semiring | str = TROPICAL, weight: float | None = None) -> Relation:
        """The strings of a column as an acceptor; nulls are no strings."""
        w = semiring(ring).weight(weight)
        return cls(df.where(F.col(column).isNotNull()).select(F.col(column).alias("istring"), F.col(column).alias("ostring"), F.lit(w).alias("weight")), ring)

    def _with(self, df: DataFrame, *others: Relation, added: bool = False) -> Relation:
        """With the rows of all added, or of at most their product."""
        most = self.most
        for o in others:
            most = (most + o.most if added else most * o.most) if most and o.most else 0
        return Relation(df, self.semiring, most if most <= MOST_LITERALS else 0)

    @property
    def bounded(self) -> bool:
        """Made of literals, at most MOST_LITERALS rows of them."""
        return self.most > 0

    def _side(self) -> DataFrame:
        return F.broadcast(self.df) if self.bounded else self.df

    # -- sums

    def merged(self) -> Relation:
        """One row a pair: weights of equal pairs added."""
        return self._with(self.semiring.sums(self.df, ["istring", "ostring"]))

    def union(self, *others: Relation) -> Relation:
        same(self, *others)
        df = self.df
        for o in others:
            df = df.unionByName(o.df)
        return self._with(df, *others, added=True)

    # -- sides

    def project(self, side: str) -> Relation:
        if side not in ("input", "output"):
            raise ArgumentError(f"no side of a relation: {side}")
        c = F.col("istring" if side == "input" else "ostring")
        return self._with(self.df.select(c.alias("istring"), c.alias("ostring"), "weight"))

    def invert(self) -> Relation:
        return self._with(self.df.select(F.col("ostring").alias("istring"), F.col("istring").alias("ostring"), "weight"))

    def reverse(self) -> Relation:
        return self._with(self.df.select(F.reverse("istring").alias("istring"), F.reverse("ostring").alias("ostring"), "weight"))

    # -- weights

    def weights(self, kind: str, weight: float | None = None, power: int = 1, delta: float = DELTA) -> Relation:
        """invert, plus, times, power, quantize, rmweight."""
        w, r = F.col("weight"), self.semiring
        ways = {
            "identity": lambda: w, "invert": lambda: F.when(w == INFINITY, w).otherwise(-w), "plus": lambda: r.plus_columns(w, F.lit(r.weight(weight))),
            "times": lambda: r.times_columns(w, F.lit(r.weight(weight))), "power": lambda: r.power_columns(w, F.lit(power)),
            "quantize": lambda: quantized(w, delta), "rmweight": lambda: F.when(w == INFINITY, w).otherwise(F.lit(0.0)),
        }
        if kind not in ways:
            raise ArgumentError(f"unknown map: {kind}")
        return self._with(self.df.withColumn("weight", ways[kind]()))

    # -- joins

    def compose(self, other: Relation) -> Relation:
        """All pairs whose middle strings are equal; weights in sequence."""
        same(self, other)
        right = other._side().select(F.col("istring").alias("middle"), F.col("ostring").alias("out"), F.col("weight").alias("w"))
        joined = self.df.join(right, F.col("ostring") == F.col("middle"))
        return self._with(joined.select("istring", F.col("out").alias("ostring"), (F.col("weight") + F.col("w")).alias("weight")), other)

    def intersect(self, other: Relation) -> Relation:
        return self.compose(other)

    def difference(self, other: Relation) -> Relation:
        """Strings of this acceptor that the other does not hold."""
        same(self, other)
        right = other._side().select(F.col("istring").alias("gone"))
        return self._with(self.df.join(right, F.col("ostring") == F.col("gone"), "left_anti"), other)

    def leniently_compose(self, other: Relation) -> Relation:
        """Composition where the other is defined; the middle string itself elsewhere."""
        same(self, other)
        right = other._side().select(F.col("istring").alias("middle"), F.col("ostring").alias("out"), F.col("weight").alias("w"))
        joined = self.df.join(right, F.col("ostring") == F.col("middle"), "left")
        return self._with(joined.select("istring", F.coalesce("out", "ostring").alias("ostring"), (F.col("weight") + F.coalesce("w", F.lit(0.0))).alias("weight")), other)

    def priority_union(self, other: Relation) -> Relation:
        """This relation, and the other's rows for inputs that this one lacks."""
        same(self, other)
        mine = self._side().select(F.col("istring").alias("have"))
        return self._with(self.df.unionByName(other.df.join(mine, F.col("istring") == F.col("have"), "left_anti")), other, added=True)

    def cross(self, other: Relation) -> Relation:
        """Every string of one with every string of the other; as many rows as the product, so the other is mostly small."""
        same(self, other)
        right = other._side().select(F.col("istring").alias("out"), F.col("weight").alias("w"))
        return self._with(self.df.crossJoin(right).select("istring", F.col("out").alias("ostring"), (F.col("weight") + F.col("w")).alias("weight")), other)

    def concat(self, other: Relation) -> Relation:
        """Both sides of every pair with every pair of the other appended; as many rows as the product."""
        same(self, other)
        right = other._side().toDF("i2", "o2", "w2")
        return self._with(self.df.crossJoin(right).select(F.concat("istring", "i2").alias("istring"), F.concat("ostring", "o2").alias("ostring"), (F.col("weight") + F.col("w2")).alias("weight")), other)

    def _must_be_bounded(self, what: str) -> None:
        if not self.bounded:
            raise OperationError(f"{what} takes a right side made from at most {MOST_LITERALS} literal rows")

    def closure(self, lower: int, upper: int) -> Relation:
        """`lower` to `upper` repetitions of a bounded relation, upper >= 1."""
        if lower < 0 or upper < max(lower, 1):
            raise ArgumentError(f"no bounded range of repetitions: {lower} to {upper}")
        self._must_be_bounded("closure")
        spark = self.df.sparkSession
        level = Relation.of_rows(spark, [("", "")], self.semiring)
        out = level if lower == 0 else None
        for n in range(1, upper + 1):
            level = level.concat(self)
            if n >= lower:
                out = out.union(level) if out else level
        return out.merged()

    # -- ranks

    def prune(self, weight: float, per_input: bool = False) -> Relation:
        """Rows within `weight` of the best of all, or of the best for the same input."""
        self.semiring.require_best_path("prune")
        if per_input:
            best = F.min("weight").over(Window.partitionBy("istring"))
            return self._with(self.df.withColumn("best", best).where(F.col("weight") <= F.col("best") + weight))
        best = self.df.agg(F.min("weight")).scalar()
        return self._with(self.df.where(F.col("weight") <= best + weight))

    def shortest(self, n: int = 1, unique: bool = True) -> Relation:
        """The n best outputs of each input; ties by output."""
        self.semiring.require_best_path("shortest")
        own = self.merged() if unique else self
        return self._with(top(own.df, ["istring"], n))

    def optimal(self) -> Relation:
        """All outputs of each input that tie for the best."""
        self.semiring.require_best_path("optimal")
        return self._with(optimal(self.merged().df, ["istring"]))

    def total(self) -> DataFrame:
        """The added weight of all rows."""
        return self.semiring.sums(self.df.select("weight"), [])

    def disambiguate(self) -> Relation:
        """One output an input: the best, with the added weight of all."""
        s = self.semiring
        first = self.df.groupBy(F.col("istring").alias("i")).agg(F.min_by("ostring", F.struct("weight", "ostring")).alias("ostring"))
        return self._with(s.sums(self.df, ["istring"]).join(first, F.col("istring").eqNullSafe(F.col("i"))).select("istring", "ostring", "weight"))

    # -- tests

    def matches(self, pairs: DataFrame) -> DataFrame:
        """The rows (istring, ostring) that belong to the relation."""
        return pairs.join(self._side().select("istring", "ostring"), ["istring", "ostring"], "left_semi")

    def equivalent(self, other: Relation, delta: float = DELTA) -> bool:
        same(self, other)
        a, b = self.merged().df, other.merged().df.withColumnRenamed("weight", "w")
        off = a.join(b, ["istring", "ostring"], "full").where("weight is null or w is null or not (weight <=> w or abs(weight - w) <= " + repr(delta) + ")")
        return off.isEmpty()

    def randgen(self, n: int, seed: int = 0, weighted: bool = False) -> Relation:
        """n rows without replacement, uniform or with probability by exp(-weight)."""
        key = -F.log(F.rand(seed)) / (F.exp(-F.col("weight")) if weighted else F.lit(1.0))
        return self._with(self.df.orderBy(key).limit(n))

    def string(self) -> str:
        """The output of a relation with exactly one row."""
        found = self.df.limit(2).collect()
        if len(found) != 1:
            raise OperationError("no single string" if found else "no string")
        return found[0].ostring

    def items(self):
        """(istring, ostring, weight) of every row, one partition at a time."""
        return (tuple(r) for r in self.df.toLocalIterator())


# ---------------------------------------------------------------- ranking of candidates of any key


def _order() -> list[Column]:
    return [quantized(F.col("weight"), FINE_DELTA), F.col("ostring")]


def rewrites(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Distinct outputs of each key with their best weight."""
    return candidates.groupBy(*key, "ostring").agg(F.min("weight").alias("weight"))


def top(candidates: DataFrame, key: list[str], n: int = 1) -> DataFrame:
    """The n best rows of each key; row_number lets the planner limit groups before it shuffles."""
    w = Window.partitionBy(*key).orderBy(*_order())
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def optimal(candidates: DataFrame, key: list[str]) -> DataFrame:
    """All rows of each key that tie for the best weight."""
    w = Window.partitionBy(*key).orderBy(quantized(F.col("weight"), FINE_DELTA))
    return candidates.withColumn("place", F.rank().over(w)).where("place = 1").drop("place")


def best(candidates: DataFrame, key: list[str]) -> DataFrame:
    """One best output of each key, the first of equals."""
    return candidates.groupBy(*key).agg(F.min_by("ostring", F.struct(*[c.alias(n) for c, n in zip(_order(), "wo")])).alias("ostring"), F.min("weight").alias("weight"))


def only_best(candidates: DataFrame, key: list[str], strict: bool = True) -> DataFrame:
    """The best output of each key; a tie is an error that names two, or null if not strict."""
    tied = optimal(rewrites(candidates, key), key).groupBy(*key).agg(F.min("ostring").alias("ostring"), F.max("ostring").alias("other"), F.min("weight").alias("weight"))
    two = F.col("ostring") != F.col("other")
    fail = F.raise_error(F.concat(F.lit("several best outputs: "), "ostring", F.lit(", "), "other")) if strict else F.lit(None).cast("string")
    return tied.withColumn("ostring", F.when(two, fail).otherwise(F.col("ostring"))).drop("other")
