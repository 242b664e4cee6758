"""Quality classifier: a factorisation machine over hashed words, structure and length.

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise sum is taken in time linear in the features: half of the squared sum minus the
sum of squares, factor by factor.  Features are the distinct lower-cased words of the whole
text, hashed into `buckets` (their weights have length one for each text), shares that
describe its structure, and metadata: its own length in bytes and words.  Labels, language,
source and id are no inputs.

It is fitted on a bounded sample of labelled rows, one an id, `sample` of them and
MOST_BYTES of features at most, chosen by a hash of the id among those whose crc32(id as text) mod 3 is not 1; the others are held out.
Fitting is deterministic.  Label rows with null id or quality are not used; of several
labels of one id the lowest counts.  Without labels every score is 0.5.

Null and empty texts are scored from their structure alone.  Rows are independent, so
repeated rows and ties do not matter; a null id is never held out.  Other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .quality_rules import SIGNALS, count_texts

BUCKETS = 1 << 15
FACTORS = 6
SAMPLE = 6000
MOST_BYTES = 256 * tb.MEGABYTE
STEPS = 564  # twelve passes over a full sample in batches of 128
STRUCTURE = (*SIGNALS, "mean_word", "line_words", "log_words", "log_bytes", "digits", "stops")

RESULT = "doc_id long, held_out boolean, score double, predicted int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


@dataclass
class Features:
    """Sparse rows: row i has columns[start[i]:start[i + 1]]."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def rows(self, which: np.ndarray) -> Features:
        n = np.diff(self.start)[which]
        at = tb.ranges(self.start[which], n)
        return Features(np.concatenate(([0], np.cumsum(n))), self.columns[at], self.values[at])


def features(texts: tb.Texts, buckets: int = BUCKETS) -> Features:
    data = tb.lower_ascii(texts.data)
    words = tb.split_words(tb.Texts(data, texts.start))
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(words.first))
    pair, count = np.unique(doc * buckets + (tb.hash_words(data, words) % np.uint64(buckets)).astype(np.int64), return_counts=True)
    row, column, value = pair // buckets, pair % buckets, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value = value / norm[row]
    c = {k: v.astype(np.float64) for k, v in count_texts(texts).items()}
    share = lambda a, b: a / np.maximum(b, 1)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[texts.start])
    size = np.diff(texts.start)
    dense = [share(c[a], c[b]) for a, b in SIGNALS.values()]
    dense += [share(c["word_chars"], c["n_words"]) / 10, np.log1p(share(c["n_words"], c["n_lines"])) / 4, np.log1p(c["n_words"]) / 10, np.log1p(size) / 12]
    dense += [share(total((data >= 48) & (data <= 57)), size), share(total(data == 46), c["n_words"])]
    k = len(STRUCTURE)
    row = np.concatenate((row, np.repeat(np.arange(n), k)))
    column = np.concatenate((column, np.tile(buckets + np.arange(k), n)))
    value = np.concatenate((value, np.stack(dense, 1).ravel()))
    order = np.argsort(row, kind="stable")
    return Features(np.searchsorted(row[order], np.arange(n + 1)), column[order].astype(np.int32), value[order].astype(np.float32))


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray  # one a feature
    factors: np.ndarray  # FACTORS a feature

    @classmethod
    def empty(cls, buckets: int = BUCKETS, n_factors: int = FACTORS) -> FactorisationMachine:
        n = buckets + len(STRUCTURE)
        start = np.random.default_rng(7).normal(0, 0.02, (n, n_factors))
        return cls(0.0, np.zeros(n, np.float32), start.astype(np.float32))

    @property
    def buckets(self) -> int:
        return len(self.weights) - len(STRUCTURE)

    def _sums(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and each row's sum of v_i x_i for each factor."""
        row_sum = lambda v: np.add.reduceat(v, x.start[:-1], axis=0)  # noqa: E731  every row has its structure features
        vx = self.factors[x.columns] * x.values[:, None]
        s = row_sum(vx)
        return self.bias + row_sum(self.weights[x.columns] * x.values) + 0.5 * (s**2 - row_sum(vx**2)).sum(1), s

    def scores(self, x: Features) -> np.ndarray:
        if len(x.start) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._sums(x)[0].astype(np.float64), -30, 30)))

    def fit(self, x: Features, y: np.ndarray, steps: int = STEPS, batch: int = 128, rate: float = 0.08, decay: float = 1e-5) -> None:
        """Logistic loss by AdaGrad; gradients of a batch are summed feature by feature.  Every sample gets as many steps."""
        rng, n = np.random.default_rng(11), len(self.weights)
        seen_w, seen_v, seen_b = np.full(n, 1e-3), np.full(self.factors.shape, 1e-3), 1e-3
        turn, low = np.zeros(0, np.int64), 0
        for _ in range(steps if len(y) else 0):
            if low >= len(turn):
                turn, low = rng.permutation(len(y)), 0
            which = np.sort(turn[low : low + batch])
            low += batch
            part = x.rows(which)
            margin, s = self._sums(part)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[which]) / len(which)
            each = np.repeat(slope, np.diff(part.start)) * part.values
            used, place = np.unique(part.columns, return_inverse=True)
            g = np.bincount(place, each, len(used)) + decay * self.weights[used]
            seen_w[used] += g**2
            self.weights[used] -= (rate * g / np.sqrt(seen_w[used])).astype(np.float32)
            inner = np.repeat(s, np.diff(part.start), axis=0) - self.factors[part.columns] * part.values[:, None]
            g = np.stack([np.bincount(place, each * inner[:, f], len(used)) for f in range(inner.shape[1])], 1) + decay * self.factors[used]
            seen_v[used] += g**2
            self.factors[used] -= (0.3 * rate * g / np.sqrt(seen_v[used])).astype(np.float32)
            g = float(slope.sum())
            seen_b += g**2
            self.bias -= rate * g / np.sqrt(seen_b)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> FactorisationMachine:
    """A machine fitted on at most `sample` labelled ids that are not held out, and at most MOST_BYTES of their features.

    Of several texts of one id the first in string order counts.  Ids beyond the bounds are
    those of the largest hashes.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bound that allows the broadcast below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.texts_of(batch["text"]).chunks():
                x = features(texts, buckets)
                part = batch.slice(a, b - a)
                cells = [(x.columns[i:j].tobytes(), x.values[i:j].tobytes()) for i, j in zip(x.start[:-1], x.start[1:])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["good"], *(pa.array([c[k] for c in cells], pa.binary()) for k in (0, 1))], ["doc_id", "good", "columns", "values"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one_each = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    made = tb.checkpointed(one_each.mapInArrow(run, "doc_id long, good int, columns binary, values binary"))
    size, used = F.octet_length("columns") + F.octet_length("values"), 0
    beyond = []
    for row in made.select("doc_id", size.alias("size"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():  # at most `sample` rows
        used += row["size"]
        if used > MOST_BYTES:
            beyond.append(row["doc_id"])
    rows = (made.where(~F.col("doc_id").isin(beyond)) if beyond else made).toArrow()
    machine = FactorisationMachine.empty(buckets)
    if rows.num_rows:
        rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending"), ("columns", "ascending"), ("values", "ascending")]))
        n = tb.lengths(rows["columns"], np.int32)
        x = Features(np.concatenate(([0], np.cumsum(n))), tb.unpacked(rows["columns"], np.int32), tb.unpacked(rows["values"], np.float32))
        machine.fit(x, rows["good"].to_numpy().astype(np.float64))
    else:
        machine.factors[:] = 0
    return machine


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.texts_of(batch["text"]).chunks():
                part = batch.slice(a, b - a)
                p = machine.scores(features(texts, machine.buckets))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=_SCHEMA)

    number = F.col(f"`{id_col}`").cast("long")
    chosen = docs.select(number.alias("doc_id"), held_out(number).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, RESULT)
