"""Features, paradigms, and the tables of word forms that they define.

A paradigm's forms are a table: stems by slots, each slot an affix around the stem and a
feature vector, then rules in order.  Analysis, tagging, lemmatizing and inflecting are
joins with it; the table is bounded by the lexicon, words may be any DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.native import regex_quoted
from ..labels import escape
from .machine import string_map


@dataclass(frozen=True)
class Feature:
    name: str
    values: tuple[str, ...]
    default: str | None = None

    def __init__(self, name: str, *values: str, default: str | None = None):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "values", tuple(dict.fromkeys([*values, *([default] if default is not None else [])])))
        object.__setattr__(self, "default", default)


@dataclass(frozen=True)
class Category:
    """A set of features, in the order of their names."""

    features: tuple[Feature, ...]

    def __init__(self, *features: Feature):
        object.__setattr__(self, "features", tuple(sorted(features, key=lambda f: f.name)))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.features)

    def vectors(self) -> list[dict[str, str]]:
        """All full assignments."""
        return [dict(zip(self.names, v)) for v in product(*[f.values for f in self.features])]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.name, v, v == f.default) for f in self.features for v in f.values], "feature string, value string, is_default boolean")

    def mapper(self):
        """A machine from the symbol of each value to its text, brackets escaped: feature_mapper."""
        return string_map([(f"[{f.name}={v}]", escape(f"[{f.name}={v}]")) for f in self.features for v in f.values])

    def read(self, c: Column) -> Column:
        """[name=value]... as a struct with a field for each feature, null where it is open or not of the category."""
        value = lambda f: F.regexp_extract(c, rf"\[{regex_quoted(f.name)}=({'|'.join(map(regex_quoted, f.values))})\]", 1)
        return F.when(c.isNotNull(), F.struct(*[F.nullif(value(f), F.lit("")).alias(f.name) for f in self.features]))

    def written(self, vector: Column) -> Column:
        """A struct of `read` as text again."""
        return F.when(vector.isNotNull(), F.concat(*[F.when(vector[n].isNotNull(), F.concat(F.lit(f"[{n}="), vector[n], F.lit("]"))).otherwise(F.lit("")) for n in self.names]))

    def fill(self, given: dict[str, str]) -> list[dict[str, str]]:
        """A missing feature takes its default; without one, every value."""
        options = [[given[f.name]] if f.name in given else [f.default] if f.default is not None else list(f.values) for f in self.features]
        return [dict(zip(self.names, v)) for v in product(*options)]


@dataclass(frozen=True)
class FeatureVector:
    """Values of some features of a category; the others are open."""

    category: Category
    given: tuple[tuple[str, str], ...]

    def __init__(self, category: Category, *pairs: str):
        domain = {f.name: f.values for f in category.features}
        found: dict[str, str] = {}
        for p in pairs:
            name, sep, value = p.partition("=")
            if not sep or name not in domain or value not in domain[name]:
                raise ArgumentError(f"not a feature of the category: {p}")
            if found.setdefault(name, value) != value:
                raise ArgumentError(f"two values of {name}")
        object.__setattr__(self, "category", category)
        object.__setattr__(self, "given", tuple(sorted(found.items())))

    @property
    def values(self) -> dict[str, str]:
        return dict(self.given)

    def unify(self, other: FeatureVector) -> FeatureVector | None:
        """Both vectors' values; None if the categories differ or a value clashes."""
        if self.category != other.category:
            return None
        a, b = self.values, other.values
        if any(b.get(k, v) != v for k, v in a.items()):
            return None
        return FeatureVector(self.category, *[f"{k}={v}" for k, v in {**a, **b}.items()])

    def text(self) -> str:
        """[name=value] for each feature in order; open features in every value are left out."""
        v = self.values
        return "".join(f"[{n}={v[n]}]" for n in self.category.names if n in v)


def unify_columns(a: Column, b: Column, names: tuple[str, ...]) -> Column:
    """Unification of two structs with a nullable field for each feature; null on a clash."""
    ok = F.lit(True)
    for n in names:
        ok = ok & (a[n].isNull() | b[n].isNull() | (a[n] == b[n]))
    return F.when(ok, F.struct(*[F.coalesce(a[n], b[n]).alias(n) for n in names]))


STEM = "{}"


def prefix(affix: str, shape: str = STEM) -> str:
    return affix + shape


def suffix(affix: str, shape: str = STEM) -> str:
    return shape + affix


@dataclass
class Paradigm:
    """Slots are (shape, FeatureVector), a shape is text around {}; rules map columns to columns.

    A slot's shape may also be a function of the stem column.  A parent's slots are added
    unless a slot here has the same vector; its rules are taken if none are given.
    """

    category: Category
    slots: list[tuple[str | Callable[[Column], Column], FeatureVector]]
    lemma: FeatureVector
    stems: list[str] | DataFrame  # a table has a column stem
    rules: list[Callable[[Column], Column]] | None = None
    name: str = ""
    boundary: str = "+"
    parent: Paradigm | None = None
    _forms: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.parent is not None:
            if self.parent.category != self.category or self.parent.boundary != self.boundary:
                raise ArgumentError("a parent has the same category and boundary")
            have = {v for _, v in self.slots}
            self.slots = [*self.slots, *[s for s in self.parent.slots if s[1] not in have]]
            if self.rules is None:
                self.rules = self.parent.rules
        if any(v.category != self.category for _, v in self.slots):
            raise ArgumentError("a slot has another category")
        if self.lemma not in {v for _, v in self.slots}:
            raise ArgumentError("no slot has the lemma's features")

    def forms(self, spark: SparkSession) -> DataFrame:
        """stem, slot, form with boundaries, surface form, features text; one row a stem and slot."""
        stems = self.stems.select("stem") if isinstance(self.stems, DataFrame) else spark.createDataFrame([(s,) for s in self.stems], "stem string")
        parts = []
        for k, (shape, vector) in enumerate(self.slots):
            c = F.col("stem")
            made = shape(c) if callable(shape) else F.concat(*[x for piece in _pieces(shape) for x in ([c] if piece == STEM else [F.lit(piece)])])
            parts.append(F.struct(F.lit(k).alias("slot"), made.alias("raw"), F.lit(vector.text()).alias("features"), F.lit(vector == self.lemma).alias("is_lemma")))
        rows = stems.select("stem", F.inline(F.array(*parts)))
        form = F.col("raw")
        for rule in self.rules or ():
            form = rule(form)
        return rows.select("stem", "slot", form.alias("form"), "features", "is_lemma").withColumn("surface", F.regexp_replace("form", regex_quoted(self.boundary), ""))

    def _side(self, table: DataFrame) -> DataFrame:
        """A listed lexicon is broadcast; one that is a table is joined as the planner sees fit."""
        return table if isinstance(self.stems, DataFrame) else F.broadcast(table)

    def analyze(self, words: DataFrame, word: str) -> DataFrame:
        """words' columns, segmented form, features: one row a reading; words without one have none."""
        forms = self.forms(words.sparkSession).select(F.col("surface").alias("_surface"), "form", "features")
        return words.join(self._side(forms), F.col(word) == F.col("_surface")).drop("_surface")

    def tag(self, words: DataFrame, word: str) -> DataFrame:
        """words' columns and features."""
        return self.analyze(words, word).drop("form").distinct()

    def lemmas(self, spark: SparkSession) -> DataFrame:
        """surface, lemma, features."""
        forms = self.forms(spark)
        lemma = forms.where("is_lemma").select("stem", F.col("surface").alias("lemma"))
        return forms.join(lemma, "stem").select("surface", "lemma", "features")

    def lemmatize(self, words: DataFrame, word: str) -> DataFrame:
        """words' columns, lemma, features."""
        table = self.lemmas(words.sparkSession).toDF("_surface", "lemma", "features")
        return words.join(self._side(table), F.col(word) == F.col("_surface")).drop("_surface")

    def analyze_strictly(self, words: DataFrame, word: str) -> DataFrame:
        """`analyze`, but a word without a reading is an error; a null word has no row."""
        forms = self.forms(words.sparkSession).select(F.col("surface").alias("_surface"), "form", "features")
        found = words.where(F.col(word).isNotNull()).join(self._side(forms), F.col(word) == F.col("_surface"), "left")
        read = F.when(F.col("_surface").isNull(), F.raise_error(F.concat(F.lit("no reading of "), F.col(word)))).otherwise(F.col("form"))
        return found.withColumn("form", read.cast("string")).drop("_surface")

    def inflect(self, lemmas: DataFrame, lemma: str, vector: FeatureVector) -> DataFrame:
        """lemmas' columns and the form with exactly these features."""
        table = self.lemmas(lemmas.sparkSession).where(F.col("features") == vector.text()).select(F.col("lemma").alias("_lemma"), F.col("surface").alias("form"))
        return lemmas.join(self._side(table), F.col(lemma) == F.col("_lemma")).drop("_lemma")


def without_boundary(c: Column, boundary: str = "+") -> Column:
    """Whether a string is made of anything but the boundary."""
    return ~F.contains(c, F.lit(boundary))


def _pieces(shape: str) -> list[str]:
    if shape.count(STEM) != 1:
        raise ArgumentError(f"a shape holds the stem once: {shape}")
    a, b = shape.split(STEM)
    return [x for x in (a, STEM, b) if x]


def stem_ids(stems: DataFrame, column: str = "stem") -> DataFrame:
    """stems with an id text __n__, by order of the stems; for lexicons of a paradigm's size."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(column)) - 1
    return stems.withColumn("stem_id", F.format_string("__%d__", n))
