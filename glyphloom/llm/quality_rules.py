"""Quality rules whose cutoffs are chosen under a guaranteed rate of false rejections.

Each signal is a share in thousandths; a document is rejected where one reaches its
cutoff.  Cutoffs are chosen for each stratum (a stated list of languages, and one for the
rest) on labelled documents, one draw an id and one an equal text: of several texts of an
id the one with the least digest counts, and ids with equal texts are one draw, good if all
of them are.  A digest of the text splits the draws in two.  The smaller part
proposes: for each signal the cutoff that rejects most of the bad at little cost among the
good, and an order of the signals, the most useful first.  The larger part tests the rule
sets that this order builds up (the first signal, the first two, ...), each as a whole: a
set is safe if the exact binomial test rejects that it hits `total_risk` or more of the
good documents, P[Bin(n, total_risk) <= k] <= delta / strata.  The sets are nested and
their order was fixed without the documents that test them, so they are tested one after
the other, each at the full level, up to the first that is not safe; the strata share
delta (Bonferroni).  With probability 1 - delta, no stratum loses more than `total_risk` of
its good documents.  Without a safe set (too few labels, say) no signal rejects there.

Base failures (few words, much repetition) are rules of their own and need no labels.

Null and empty texts have no words and fail the base rule.  Rows are counted and judged one
by one, repeated ones alike; how often a labelled row or text is listed does not change what
is certified.  Label rows with null id or quality are not used; of
several labels of one id the lowest counts.  Other columns are carried along untouched by
`statistics_of`; a column that has its name already is an error.  Empty tables give empty
results, and an empty label table no cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

SYMBOLS = b"#*$%&|<>"
SHOUTS = b"!"

#: What is counted in each text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")

#: name: (what, of how much)
SIGNALS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "shouts": ("n_shouts", "word_chars"),
}

#: Cutoffs that are tried, in thousandths.
CUTOFFS = (10, 20, 30, 50, 80, 120, 160, 200, 250, 300, 400, 500, 650, 800)

#: First hex digits of md5(text) of the draws that propose; the others test.
PROPOSING = ("0", "1", "2", "3", "4")

LANGUAGES = ("en", "fr", "de", "es")
OTHER = "other"


def _counted(mask: np.ndarray, texts: tb.Texts) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return np.diff(total[texts.start])


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (document, key) pairs: the places of all that occur twice or more, and of all but each one's first."""
    joint = tb.mix(keys + doc.astype(np.uint64) * tb.STEPS[5])
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    later = order[1:][same]
    return np.union1d(later, order[:-1][same]), later


def count_texts(texts: tb.Texts) -> dict[str, np.ndarray]:
    n, data = len(texts), texts.data
    gap = tb.space_mask(data)
    words = tb.split_words(texts, gap)
    n_words = np.diff(words.first)
    one_of = lambda chars: np.isin(np.arange(256), list(chars))[data]
    lines = tb.split_words(texts, data == 10)
    filled = np.diff(np.concatenate(([0], np.cumsum(~gap)))[np.stack((lines.begin, lines.end), 1)], axis=1)[:, 0] > 0 if len(lines.begin) else np.zeros(0, bool)
    line_doc = np.repeat(np.arange(n), np.diff(lines.first))[filled]
    line_hash = tb.hash_words(data, tb.Words(lines.begin[filled], lines.end[filled], lines.first))
    at = tb.inside_texts(words.first, 3)
    hashes = tb.hash_words(data, words)
    doc = np.repeat(np.arange(n), np.maximum(n_words - 2, 0))
    again = at[_repeats(tb.hash_windows(hashes, 3)[at], doc)[0]] if len(at) else at
    covered = np.concatenate(([0], np.cumsum(tb.spread(again, 3, len(hashes)))))
    return {
        "n_words": n_words,
        "word_chars": _counted(~gap & ((data & 0xC0) != 0x80), texts),
        "n_symbols": _counted(one_of(SYMBOLS), texts),
        "n_dup_lines": np.bincount(line_doc[_repeats(line_hash, line_doc)[1]], minlength=n),
        "n_repeat_words": np.diff(covered[words.first]),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_capitals": _counted((data >= 65) & (data <= 90), texts),
        "n_shouts": _counted(one_of(SHOUTS), texts),
    }


def statistics_of(docs: DataFrame, text_col: str = "text", to: str = "quality_counts") -> DataFrame:
    """docs with a struct of COUNTS for each text; docs may hold any other columns."""
    if to.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {to} already")
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.texts_of(batch[text_col]).chunks():
                counted = count_texts(texts)
                made = pa.StructArray.from_arrays([pa.array(counted[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, made], [*batch.schema.names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, kind)]))


def at_most(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) <= k], exactly summed."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


@dataclass(frozen=True)
class RiskControlledRules:
    """Cutoffs in thousandths by stratum and signal; a signal without one rejects nothing there."""

    strata: tuple[str, ...] = LANGUAGES
    total_risk: float = 0.05
    delta: float = 0.05
    cost: int = 10
    min_words: int = 50
    max_repeat_percent: int = 50
    cutoffs: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def level(self) -> float:
        return self.delta / (len(self.strata) + 1)

    def stratum(self, lang: Column) -> Column:
        return F.when(lang.isin(*self.strata), lang).otherwise(F.lit(OTHER))

    def base_failed(self, of: str = "") -> Column:
        n, again = F.col(f"{of}n_words"), F.col(f"{of}n_repeat_words")
        return (n < self.min_words) | (100 * again > self.max_repeat_percent * n)

    @staticmethod
    def _reaches(signal: str, cutoff, of: str = "") -> Column:
        what, whole = SIGNALS[signal]
        return (F.col(f"{of}{whole}") > 0) & (1000 * F.col(f"{of}{what}") >= cutoff * F.col(f"{of}{whole}"))

    def labelled(self, counted: DataFrame, labels: DataFrame) -> DataFrame:
        """The draws, labelled documents that pass the base rule: stratum, COUNTS, good, and whether they propose or test."""
        known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
        both = counted.where(~self.base_failed()).join(known, "doc_id")
        one = both.groupBy("doc_id").agg(F.min(F.struct("digest", "lang", *COUNTS, "good")).alias("r")).select("r.*")
        draws = one.groupBy(self.stratum(F.col("lang")).alias("stratum"), "digest").agg(*[F.min(c).alias(c) for c in (*COUNTS, "good")])
        return draws.select("stratum", *COUNTS, "good", F.substring("digest", 1, 1).isin(*PROPOSING).alias("proposes"))

    def proposals(self, labelled: DataFrame) -> dict[str, list[tuple[str, int]]]:
        """By stratum: signals with their cutoffs, the most useful first; at most len(strata) + 1 rows of counts come to the driver."""
        hits = [F.count_if(self._reaches(s, c) & (F.col("good") == F.lit(g))).alias(f"{s}_{c}_{g}".lower()) for s in SIGNALS for c in CUTOFFS for g in (True, False)]
        out = {}
        for row in labelled.where("proposes").groupBy("stratum").agg(*hits).collect():
            best = []
            for at, s in enumerate(SIGNALS):
                worth, cutoff = max((row[f"{s}_{c}_false"] - self.cost * row[f"{s}_{c}_true"], c) for c in CUTOFFS)
                if worth > 0:
                    best.append((-worth, at, s, cutoff))
            out[row["stratum"]] = [(s, c) for _, _, s, c in sorted(best)]
        return out

    def safe(self, hits: list[int], n: int) -> int:
        """How many of the nested rule sets are safe, given how many of n good documents each hits."""
        for done, k in enumerate(hits):
            if at_most(k, n, self.total_risk) > self.level:
                return done
        return len(hits)

    def fit(self, counted: DataFrame, labels: DataFrame) -> RiskControlledRules:
        """Rules with cutoffs; counted: doc_id, lang, digest (of the text) and COUNTS; all labelled documents are counted."""
        labelled = tb.checkpointed(self.labelled(counted, labels))
        proposed = self.proposals(labelled)
        testing = labelled.where("good and not proposes")
        steps = range(len(SIGNALS))
        hit = [F.lit(False) for _ in steps]
        for stratum, rules in sorted(proposed.items()):
            for k in steps:
                for s, c in rules[: k + 1]:
                    hit[k] = hit[k] | ((F.col("stratum") == stratum) & self._reaches(s, c))
        found = {}
        for row in testing.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(h).alias(f"hit_{k}") for k, h in enumerate(hit)]).collect():
            rules = proposed.get(row["stratum"], [])
            found[row["stratum"]] = dict(rules[: self.safe([row[f"hit_{k}"] for k in range(len(rules))], row["n"])])
        return RiskControlledRules(self.strata, self.total_risk, self.delta, self.cost, self.min_words, self.max_repeat_percent, found)

    def rejected(self, lang: Column, of: str = "") -> Column:
        """Whether a signal reaches its cutoff; `of` is a prefix of the count columns' names."""
        out = F.lit(False)
        for stratum, best in sorted(self.cutoffs.items()):
            hit = F.lit(False)
            for s, c in sorted(best.items()):
                hit = hit | self._reaches(s, c, of)
            out = out | ((self.stratum(lang) == stratum) & hit)
        return out


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def judge(docs: DataFrame, labels: DataFrame, rules: RiskControlledRules | None = None) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for each document; docs has doc_id, text and lang."""
    counted = tb.checkpointed(statistics_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")).select("doc_id", "lang", _digest().alias("digest"), "quality_counts.*"))
    fitted = (rules or RiskControlledRules()).fit(counted, labels)
    failed = fitted.base_failed()
    return counted.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~fitted.rejected(F.col("lang"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, rules: RiskControlledRules | None = None) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names; texts are counted once."""
    name = "quality_counts"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    counted = tb.Written(docs)(statistics_of(docs, to=name))
    fitted = (rules or RiskControlledRules()).fit(counted.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", _digest().alias("digest"), f"{name}.*"), labels)
    of = f"{name}."
    return counted.where(~fitted.base_failed(of) & ~fitted.rejected(F.col("lang"), of)).drop(name)
