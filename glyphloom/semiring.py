"""Semirings: what combines the weights of equal strings, and of strings in sequence."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ArgumentError, WeightError, OperationError

INFINITY = math.inf
#: Log weights of one mass differ by less, so that their exponentials stay in range.
SPAN = 512.0
DELTA = 1 / 1024
FINE_DELTA = 1e-6


@dataclass(frozen=True)
class Semiring:
    """`tropical` takes the minimum of equal strings' weights, `log` and `log64` add probabilities; all add weights in sequence."""

    name: str

    @property
    def zero(self) -> float:
        return INFINITY

    @property
    def one(self) -> float:
        return 0.0

    @property
    def has_best_path(self) -> bool:
        return self.name == "tropical"

    def require_best_path(self, what: str) -> None:
        if not self.has_best_path:
            raise OperationError(f"{what} needs a semiring with best paths, not {self.name}")

    # -- numbers

    def plus(self, a: float, b: float) -> float:
        if self.has_best_path:
            return min(a, b)
        low, high = min(a, b), max(a, b)
        return low if math.isinf(high) else low - math.log1p(math.exp(low - high))

    def times(self, a: float, b: float) -> float:
        return self.zero if INFINITY in (a, b) else a + b

    def divide(self, a: float, b: float) -> float:
        if b == self.zero:
            raise WeightError("division by the zero weight")
        return self.zero if a == self.zero else a - b

    def power(self, a: float, n: int) -> float:
        return self.one if n == 0 else self.zero if a == self.zero else a * n

    def weight(self, value: float | str | None, default: float | None = None) -> float:
        """A weight from a number or text; None is the default, or one."""
        if value is None:
            return self.one if default is None else default
        try:
            w = float(value)
        except ValueError as e:
            raise WeightError(f"not a weight: {value!r}") from e
        if math.isnan(w) or w == -INFINITY:
            raise WeightError(f"not a member of {self.name}: {value!r}")
        return w

    def close(self, a: float, b: float, delta: float = DELTA) -> bool:
        return a == b or abs(a - b) <= delta

    # -- columns

    def plus_columns(self, a: Column, b: Column) -> Column:
        if self.has_best_path:
            return F.least(a, b)
        low, high = F.least(a, b), F.greatest(a, b)
        return F.when(high == INFINITY, low).otherwise(low - F.log1p(F.exp(low - high)))

    def times_columns(self, a: Column, b: Column) -> Column:
        return a + b

    def divide_columns(self, a: Column, b: Column) -> Column:
        return F.when(b == INFINITY, F.raise_error(F.lit("division by the zero weight"))).when(a == INFINITY, F.lit(INFINITY)).otherwise(a - b)

    def power_columns(self, a: Column, n: Column) -> Column:
        return F.when(n == 0, F.lit(0.0)).when(a == INFINITY, F.lit(INFINITY)).otherwise(a * n)

    def sums(self, df: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
        """keys and the sum of each group's weights.

        Log weights are added as masses, relative to the multiple of SPAN below them, which
        combine before the shuffle; a group then has one row for each multiple that occurs.
        """
        w = F.col(weight)
        if self.has_best_path:
            return df.groupBy(*keys).agg(F.min(w).alias(weight))
        levelled = df.select(*keys, weight, F.when(w < INFINITY, F.floor(w / SPAN)).alias("_level"))
        masses = levelled.groupBy(*keys, "_level").agg(F.sum(F.exp(F.col("_level") * SPAN - w)).alias("_mass"))
        levels = F.array_sort(F.collect_list(F.when(F.col("_level").isNotNull(), F.struct("_level", "_mass"))))
        low = F.col("_levels")[0]["_level"]
        total = F.aggregate("_levels", F.lit(0.0), lambda t, x: t + x["_mass"] * F.exp((low - x["_level"]) * SPAN))
        summed = masses.groupBy(*keys).agg(levels.alias("_levels"))
        return summed.select(*keys, F.when(F.size("_levels") > 0, low * SPAN - F.log(total)).otherwise(F.lit(INFINITY)).alias(weight))


TROPICAL, LOG, LOG64 = Semiring("tropical"), Semiring("log"), Semiring("log64")
_NAMES = {"standard": TROPICAL, "tropical": TROPICAL, "log": LOG, "log64": LOG64}


def semiring(name: str | Semiring) -> Semiring:
    if isinstance(name, Semiring):
        return name
    if name not in _NAMES:
        raise ArgumentError(f"unknown semiring: {name}")
    return _NAMES[name]


def same(*parts) -> Semiring:
    """The one semiring of all operands."""
    found = {p.semiring for p in parts}
    if len(found) != 1:
        raise ArgumentError(f"operands of different semirings: {sorted(s.name for s in found)}")
    return found.pop()


def quantized(w: Column, delta: float = FINE_DELTA) -> Column:
    """Weights that differ by rounding only become equal, so that they tie in ranks."""
    return F.when(F.abs(w) == INFINITY, w).otherwise(F.floor(w / delta + 0.5) * delta)


@dataclass(frozen=True)
class Weight:
    """A number of a semiring, for code that handles weights as values."""

    semiring: Semiring
    value: float

    @classmethod
    def of(cls, kind: Semiring | str, value: float | str | None = None) -> Weight:
        ring = semiring(kind)
        return cls(ring, ring.weight(value))

    @classmethod
    def zero(cls, kind: Semiring | str) -> Weight:
        return cls(semiring(kind), INFINITY)

    @classmethod
    def one(cls, kind: Semiring | str) -> Weight:
        return cls(semiring(kind), 0.0)

    def _with(self, other: Weight) -> Semiring:
        if self.semiring != other.semiring:
            raise ArgumentError("weights of different semirings")
        return self.semiring

    def plus(self, other: Weight) -> Weight:
        return Weight(self.semiring, self._with(other).plus(self.value, other.value))

    def times(self, other: Weight) -> Weight:
        return Weight(self.semiring, self._with(other).times(self.value, other.value))

    def divide(self, other: Weight) -> Weight:
        return Weight(self.semiring, self._with(other).divide(self.value, other.value))

    def power(self, n: int) -> Weight:
        return Weight(self.semiring, self.semiring.power(self.value, n))

    def close(self, other: Weight, delta: float = DELTA) -> bool:
        return self._with(other).close(self.value, other.value, delta)

    def __float__(self) -> float:
        return self.value

    def __str__(self) -> str:
        return "Infinity" if self.value == INFINITY else repr(self.value).removesuffix(".0")
