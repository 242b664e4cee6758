"""Edit distance against a lexicon.

With a bound of k edits a word is cut into k + 1 pieces, one of which a near query holds
unchanged, shifted by no more than the edits allow: queries and words meet on (length,
piece number, piece), so a join key is a piece of text and not a length.  Words too short to
be cut, of at most k letters, meet on their length.  A lexicon within the stated limits is
broadcast.  Unit costs are measured by Spark's levenshtein, others by a dynamic program of
expressions, a fold over one string with the row of the other.

The nearest word without a bound is looked for with bounds that double: queries that found a
word are done, and the next round is only for the rest, until the bound is above what
replacing the longest query by the longest word costs.  All distances without a bound are a
product by definition; so is a search whose edits are free.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, OperationError
from .relation import best, optimal
from .rounds import Rounds

MOST_BROADCAST = 50_000


@dataclass(frozen=True)
class EditTransducer:
    """Costs of insertion, deletion and substitution over an alphabet; bound 0 is none."""

    alphabet: frozenset[str] | None = None
    insert_cost: float = 1.0
    delete_cost: float = 1.0
    substitute_cost: float = 1.0
    bound: float = 0

    def __post_init__(self):
        if min(self.insert_cost, self.delete_cost, self.substitute_cost) < 0 or self.bound < 0:
            raise ArgumentError("costs and bound are not negative")

    def check(self, text: str) -> None:
        if self.alphabet is not None and not set(text) <= self.alphabet:
            raise OperationError(f"outside of the alphabet: {text!r}")

    def distance(self, a: str, b: str) -> float:
        """Least cost of turning a into b; an error above the bound."""
        self.check(a)
        self.check(b)
        row = [j * self.insert_cost for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i * self.delete_cost
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + self.delete_cost, row[j - 1] + self.insert_cost, before + (0 if x == y else self.substitute_cost))
        if self.bound and row[-1] > self.bound:
            raise OperationError(f"{a!r} and {b!r} are further apart than {self.bound}")
        return row[-1]

    @property
    def is_unit(self) -> bool:
        return self.insert_cost == self.delete_cost == self.substitute_cost == 1


class LevenshteinDistance(EditTransducer):
    """Distance of two strings."""


@dataclass(frozen=True)
class LevenshteinAutomaton:
    """Distances of strings to a fixed lexicon."""

    edits: EditTransducer
    lexicon: tuple[str, ...]

    def closest_matches(self, query: str) -> list[str]:
        found = {}
        for word in self.lexicon:
            try:
                found[word] = self.edits.distance(query, word)
            except OperationError:
                self.edits.check(query)
        if not found:
            raise OperationError(f"nothing in the lexicon is near {query!r}")
        least = min(found.values())
        return sorted(w for w, d in found.items() if d == least)

    def closest_match(self, query: str) -> str:
        return self.closest_matches(query)[0]


def distances(queries: DataFrame, query: str, lexicon: DataFrame, word: str, bound: float, edits: EditTransducer | None = None) -> DataFrame:
    """(query, ostring, weight) for all words within the bound, 0 for none; equal queries are compared once."""
    if bound < 0:
        raise ArgumentError("a bound is not negative")
    edits = edits or EditTransducer()
    words = lexicon.select(F.col(word).alias("ostring")).where("ostring is not null").distinct().withColumn("size", F.length("ostring"))
    asked = queries.select(F.col(query).alias(query)).where(F.col(query).isNotNull()).distinct()
    small = words.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    side = F.broadcast if small else lambda x: x
    least = min(edits.insert_cost, edits.delete_cost, edits.substitute_cost)
    if bound and least:
        pairs = _near_pairs(asked, query, words, int(bound / least + 1e-9), side)
    else:
        pairs = asked.crossJoin(side(words)).select(query, "ostring")
    if edits.is_unit:
        d = F.levenshtein(F.col(query), F.col("ostring"), int(bound)) if bound else F.levenshtein(F.col(query), F.col("ostring"))
        return pairs.withColumn("weight", d.cast("double")).where("weight >= 0").select(query, "ostring", "weight").distinct()

    pairs = pairs.withColumn("weight", _cost(F.col(query), F.col("ostring"), edits))
    return (pairs.where(F.col("weight") <= bound + 1e-9) if bound else pairs).select(query, "ostring", "weight").distinct()


def _near_pairs(asked: DataFrame, query: str, words: DataFrame, k: int, side) -> DataFrame:
    """(query, ostring) pairs, some more than once, among them all that k edits or fewer turn into each other."""
    q, size = F.col(query), F.col("size")
    cut = lambda i: F.floor(size * i / (k + 1)).cast("int")
    piece = lambda text, i, at: F.struct(i.alias("i"), F.substring(text, at + 1, cut(i + 1) - cut(i)).alias("piece"))
    numbers = F.array(*[F.lit(i) for i in range(k + 1)])
    held = words.where(size > k).select("ostring", "size", F.inline(F.transform(numbers, lambda i: piece(F.col("ostring"), i, cut(i)))))
    lengths = lambda low: F.sequence(F.greatest(F.length(q) - k, F.lit(low)), F.length(q) + k)
    long = asked.where(F.length(q) >= 1).select(query, F.explode(lengths(k + 1)).alias("size")).withColumn("more", F.length(q) - size)
    shifts = F.array(*[F.lit(d) for d in range(-k, k + 1)])

    def fits(i, shift):
        # edits before the piece make the shift, those after it the rest of the difference in length
        at = cut(i) + shift
        return (F.abs(shift) + F.abs(F.col("more") - shift) <= k) & (at >= 0) & (cut(i + 1) + shift <= F.length(q))

    cuts = F.flatten(F.transform(numbers, lambda i: F.transform(F.filter(shifts, lambda d: fits(i, d)), lambda d: piece(q, i, cut(i) + d))))
    probes = long.select(query, "size", F.inline(F.array_distinct(cuts)))
    met = probes.join(side(held), ["size", "i", "piece"]).select(query, "ostring")
    brief = asked.where(F.length(q) <= 2 * k).select(query, F.explode(F.sequence(F.greatest(F.length(q) - k, F.lit(0)), F.least(F.length(q) + k, F.lit(k)))).alias("size"))
    return met.unionByName(brief.join(side(words.where(size <= k)), "size").select(query, "ostring"))


def _cost(a: Column, b: Column, edits: EditTransducer) -> Column:
    """Least cost of turning a into b: a row of the matrix is folded over the letters of a."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    ins, gone, other = (F.lit(float(x)) for x in (edits.insert_cost, edits.delete_cost, edits.substitute_cost))
    of_b = letters(b)

    def next_row(row: Column, x: Column) -> Column:
        # what comes from the row above, and then insertions from the left
        above = F.transform(of_b, lambda y, j: F.least(F.element_at(row, j + 2) + gone, F.element_at(row, j + 1) + F.when(x == y, F.lit(0.0)).otherwise(other)))
        return F.aggregate(above, F.array(F.element_at(row, 1) + gone), lambda done, v: F.concat(done, F.array(F.least(v, F.element_at(done, -1) + ins))))

    first = F.transform(F.sequence(F.lit(0), F.size(of_b)), lambda j: j * ins)
    return F.aggregate(letters(a), first, next_row, lambda row: F.element_at(row, -1))


def closest(queries: DataFrame, query: str, lexicon: DataFrame, word: str, bound: float, all_ties: bool = False, edits: EditTransducer | None = None) -> DataFrame:
    """The nearest word of each query within the bound (0: none), or all that tie; queries without one have no row."""
    edits = edits or EditTransducer()
    chosen = (lambda near: optimal(near, [query])) if all_ties else (lambda near: best(near, [query]))
    least = min(edits.insert_cost, edits.delete_cost, edits.substitute_cost)
    if bound or not least:
        return chosen(distances(queries, query, lexicon, word, bound, edits))
    rounds = Rounds(queries.sparkSession)
    asked, n = rounds.counted(queries.select(F.col(query).alias(query)).where(F.col(query).isNotNull()).distinct())
    words, n_words = rounds.counted(lexicon.select(F.col(word).alias("word")).where("word is not null").distinct())
    longest = lambda df, c: df.agg(F.coalesce(F.max(F.length(c)), F.lit(0)).alias("n")).first()["n"]
    most = longest(asked, F.col(query)) * edits.delete_cost + longest(words, F.col("word")) * edits.insert_cost
    found, bound = None, least
    while n and n_words:
        here = rounds(chosen(distances(asked, query, words, "word", bound, edits)))
        found = here if found is None else found.unionByName(here)
        if bound >= most:
            break
        asked, n = rounds.counted(asked.join(here.select(query).distinct(), query, "left_anti"))
        bound *= 2
    if found is None:
        found = distances(asked, query, words, "word", 1, edits).limit(0)
    return rounds.done(found)[0]
