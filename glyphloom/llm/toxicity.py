"""Toxicity by the nearest labelled examples, in an exact TF-IDF cosine.

Terms are words (runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased) and
the beginnings of words of `SHORTEST` to `LONGEST` bytes, known by 64-bit hashes; what a text has
more than once also counts, once, as a term of its own.  The space is spanned by terms whose presence in the examples depends on the label (log-likelihood
ratio of at least `LEAST_RATIO`, one label's rate at least `LEAST_LIFT` times the other's, the
strongest MOST_TERMS of them); a term's weight in a text is its count times
ln((1 + N) / (1 + df)) + 1, with N and df over all documents.

Examples with equal counts are one point.  Block-max inverted index: points are ordered by
their heaviest term and cut into blocks of BLOCK; a term's postings are kept block by block
with their largest weight.  A search adds up those largest weights to a bound for each block,
opens the blocks with the highest bounds first, and stops at blocks whose bound is below the
k-th best cosine found: the nearest points are exact, cosines equal in 12 digits are taken by
the least id.  The nearest `NEIGHBOURS` examples vote with 1 / (1 - cosine + NEAR); where a
point has more examples than seats are left, they share the seats.  Votes become
probabilities by isotonic regression on the votes that the examples get from each other.  A
text without any term of the space has no neighbours and gets the rate of examples like it.
The evidence names each point by its least id, with its cosine, examples and toxic ones.

Examples are labelled ids that are not held out (crc32(id as text) mod 3 is not 1), `sample`
at most, by a hash of the id; each gives one text, of several the first in string order, and
of several labels the highest counts.  A document never is its own neighbour.  Labels, lang,
source and id are no inputs of a score.  Label rows with null id or value are not used.
Without examples every score is 0.5.  All texts are counted and scored whole; null texts are
empty.  Repeated rows are scored alike; a null id is never held out.  Other columns are not
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
from .quality_classifier import held_out
from .source_audit import letters

SAMPLE = 8000
MOST_TERMS = 2048
LEAST_RATIO = 15.0
LEAST_LIFT = 2.0
LEAST_EXAMPLES = 5
SHORTEST, LONGEST = 4, 9
AGAIN = np.uint64(0x5DEECE66D1CE4E5B)  # tells a term from the same one found more than once
NEIGHBOURS = 20
NEAR = 0.1
BLOCK = 64
TOXIC = 0.7
MOST_CELLS = 1 << 20  # of the index, or cosines, for the texts that are searched at a time

RESULT = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,examples:long,toxic:long>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("examples", pa.int64()), ("toxic", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", _EVIDENCE)])


def terms_of(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each word, and of each beginning of one that ends with a character."""
    data = tb.lower_ascii(texts.data)
    words = tb.split_words(tb.Texts(data, texts.start), ~letters(data))
    if not len(words.begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = words.end - words.begin
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    inside = np.arange(len(data)) - np.repeat(words.begin, np.diff(np.append(words.begin, len(data)))) if words.begin[0] == 0 else None
    if inside is None:
        inside = np.concatenate((np.zeros(words.begin[0], np.int64), np.arange(words.begin[0], len(data)) - np.repeat(words.begin, np.diff(np.append(words.begin, len(data))))))
    inside = np.minimum(inside, int(size.max()) - 1)  # places outside of words are not used
    coded = tb.BYTE_CODES[data] * tb.powers(tb.BASE, int(size.max()))[inside]
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(coded, dtype=np.uint64)))
    code = lambda begin, k: summed[begin + k] - summed[begin] + np.asarray(k).astype(np.uint64) * tb.STEPS[63]
    owners, hashes = [owner], [tb.mix(code(words.begin, size) + tb.STEPS[62])]
    for k in range(SHORTEST, LONGEST + 1):
        longer = np.flatnonzero(size > k)
        longer = longer[data[words.begin[longer] + k] & 0xC0 != 0x80]
        owners.append(owner[longer])
        hashes.append(tb.mix(code(words.begin[longer], k)))
    return np.concatenate(owners), np.concatenate(hashes)


@dataclass
class Rows:
    """Sparse rows: row i has places[start[i]:start[i + 1]], ascending."""

    start: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def part(self, a: int, b: int) -> Rows:
        at = slice(self.start[a], self.start[b])
        return Rows(self.start[a : b + 1] - self.start[a], self.places[at], self.values[at])

    def weighted(self, weight: np.ndarray) -> Rows:
        """Counts times weights, each row of length one."""
        value = self.values * weight[self.places]
        norm = np.sqrt(np.bincount(self.row, value**2, len(self)))
        return Rows(self.start, self.places, value / norm[self.row])


def counted(texts: tb.Texts, known: np.ndarray) -> Rows:
    """Counts of the known terms (ascending hashes) in each text."""
    text, term = terms_of(texts)
    plain = np.unique(np.concatenate((known, known ^ AGAIN)))
    if len(plain):
        bit = np.zeros(1 << 16, bool)
        bit[(plain & np.uint64(0xFFFF)).astype(np.int64)] = True
        may = np.flatnonzero(bit[(term & np.uint64(0xFFFF)).astype(np.int64)])
        text, term = text[may], term[may]
    at = tb.member(term, plain)
    pair, times = np.unique(text[at >= 0] * max(1, len(plain)) + at[at >= 0], return_counts=True)
    text, term = pair // max(1, len(plain)), plain[pair % max(1, len(plain))]
    own, again = tb.member(term, known), np.where(times > 1, tb.member(term ^ AGAIN, known), -1)
    text, place, value = (np.concatenate(x) for x in ((text[own >= 0], text[again >= 0]), (own[own >= 0], again[again >= 0]), (times[own >= 0], np.ones((again >= 0).sum()))))
    order = np.lexsort((place, text))
    return Rows(np.searchsorted(text[order], np.arange(len(texts) + 1)), place[order], value[order].astype(np.float64))


def packed_rows(rows: Rows) -> list[pa.Array]:
    cut = lambda v, dtype: pa.array([v[a:b].astype(dtype).tobytes() for a, b in zip(rows.start[:-1], rows.start[1:])], pa.binary())
    return [cut(rows.places, np.int32), cut(rows.values, np.int64)]


def unpacked_rows(table: pa.Table | pa.RecordBatch) -> Rows:
    n = tb.lengths(table["places"], np.int32)
    return Rows(np.concatenate(([0], np.cumsum(n))), tb.unpacked(table["places"], np.int32).astype(np.int64), tb.unpacked(table["counts"], np.int64).astype(np.float64))


class Index:
    """Block-max inverted index over the examples' distinct vectors: points, each with its examples."""

    def __init__(self, rows: Rows, ids: np.ndarray, toxic: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        full = np.flatnonzero(np.diff(rows.start))
        first, same = distinct(rows)
        points = rows.weighted(weights)
        heaviest = np.full(len(rows), -1)
        by_weight = np.lexsort((points.values, points.row))
        heaviest[full] = points.places[by_weight[points.start[full + 1] - 1]]
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids)
        order = np.lexsort((least, heaviest[first]))
        order = order[heaviest[first[order]] >= 0]
        place = np.full(len(first), -1)
        place[order] = np.arange(len(order))
        self.block, self.n_blocks, self.least = block, max(1, -(-len(order) // block)), least[order]
        used = place[same] >= 0
        self.n, self.bad = (np.bincount(place[same][used], w, len(order)).astype(np.int64) for w in (None, toxic[used]))
        by_id = np.argsort(ids)
        self.ids, self.point_of, self.toxic_of = ids[by_id], place[same][by_id], toxic[by_id]
        mine = np.isin(points.row, first[order])
        row, term, value = place[same[points.row[mine]]], points.places[mine], points.values[mine]
        order = np.lexsort((row, term))
        self.point, self.weight = row[order], value[order]
        cell = term[order] * self.n_blocks + self.point // block
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
        self.cell_block, self.cell_first = cell[begins] % self.n_blocks, np.append(begins, len(cell))
        self.cell_most = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0)
        self.term_first = np.searchsorted(cell[begins] // self.n_blocks, np.arange(len(weights) + 1))

    def nearest(self, queries: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, cosine), nearest first, of the k nearest points of each query whose cosine is above 0."""
        found = []
        cells = np.concatenate(([0], np.cumsum(self.term_first[queries.places + 1] - self.term_first[queries.places])))[queries.start]
        a = 0
        while a < len(queries):
            b = int(np.searchsorted(cells, cells[a] + MOST_CELLS, "right")) - 1
            b = min(max(b, a + 1), a + max(1, MOST_CELLS // max(1, len(self.n))), len(queries))
            query, point, cosine = self._nearest(queries.part(a, b), k)
            found.append((query + a, point, cosine))
            a = b
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _nearest(self, queries: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(queries), self.n_blocks * self.block
        many = self.term_first[queries.places + 1] - self.term_first[queries.places]
        cell = tb.ranges(self.term_first[queries.places], many)
        query, value = np.repeat(queries.row, many), np.repeat(queries.values, many)
        at = query * self.n_blocks + self.cell_block[cell]
        bound = np.bincount(at, value * self.cell_most[cell], n * self.n_blocks).reshape(n, self.n_blocks) + 1e-9
        bound[bound < 2e-9] = 0
        cosine, least, step = np.zeros((n, width)), np.zeros(n), 2
        while (ahead := (bound > 0) & (bound >= least[:, None])).any():
            opened = np.zeros_like(ahead)
            np.put_along_axis(opened, np.argpartition(-bound, min(step, self.n_blocks) - 1, axis=1)[:, :step], True, 1)
            opened &= ahead
            use = np.flatnonzero(opened.ravel()[at])
            size = self.cell_first[cell[use] + 1] - self.cell_first[cell[use]]
            posting = tb.ranges(self.cell_first[cell[use]], size)
            cosine += np.bincount(np.repeat(query[use], size) * width + self.point[posting], np.repeat(value[use], size) * self.weight[posting], n * width).reshape(n, width)
            bound[opened] = 0
            if width > k:
                least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
            step *= 2
        cosine = np.minimum(np.round(cosine, 12), 1.0)
        if width > k:
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
        query, point = np.nonzero((cosine > 0) & (cosine >= least[:, None]))
        cosine = cosine[query, point]
        order = np.lexsort((self.least[point], -cosine, query))
        query, point, cosine = query[order], point[order], cosine[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < k], point[rank < k], cosine[rank < k]


def distinct(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each kind, and each row's kind."""
    kinds: dict[tuple[bytes, bytes], int] = {}
    first, same = [], np.empty(len(rows), np.int64)
    for i, (a, b) in enumerate(zip(rows.start[:-1].tolist(), rows.start[1:].tolist())):
        kind = kinds.setdefault((rows.places[a:b].tobytes(), rows.values[a:b].tobytes()), len(first))
        if kind == len(first):
            first.append(i)
        same[i] = kind
    return np.array(first, np.int64), same


@dataclass
class Neighbours:
    """Of each query, its nearest points: examples beside the query itself, toxic ones, and the seats they take."""

    start: np.ndarray
    point: np.ndarray
    cosine: np.ndarray
    n: np.ndarray
    bad: np.ndarray
    seats: np.ndarray

    def votes(self) -> np.ndarray:
        """The toxic share of each query's seats, nearer ones counting more; -1 without neighbours."""
        query = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        weight = self.seats / (1 - self.cosine + NEAR)
        whole = np.bincount(query, weight, len(self.start) - 1)
        return np.where(whole > 0, np.bincount(query, weight * self.bad / self.n, len(self.start) - 1) / np.maximum(whole, 1e-300), -1.0)


@dataclass
class Calibration:
    """Non-decreasing steps from votes to probabilities."""

    begins: np.ndarray
    values: np.ndarray
    without: float

    @classmethod
    def of(cls, vote: np.ndarray, toxic: np.ndarray) -> Calibration:
        known = vote >= 0
        rate = float(toxic.mean()) if len(toxic) else 0.5
        without = float(toxic[~known].mean()) if (~known).any() else rate
        begins, at = np.unique(vote[known], return_inverse=True)
        steps: list[list[float]] = []  # begin, sum, count: neighbours that would fall are pooled
        for begin, total, count in zip(begins, np.bincount(at, toxic[known]), np.bincount(at)):
            steps.append([begin, total, count])
            while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
                _, total, count = steps.pop()
                steps[-1][1] += total
                steps[-1][2] += count
        return cls(np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps]), without)

    def __call__(self, vote: np.ndarray) -> np.ndarray:
        if not len(self.begins):
            return np.full(len(vote), self.without)
        return np.where(vote < 0, self.without, self.values[np.maximum(np.searchsorted(self.begins, vote, "right") - 1, 0)])


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    index: Index
    calibration: Calibration

    def neighbours(self, rows: Rows, own: np.ndarray, k: int = NEIGHBOURS) -> Neighbours:
        """Equal rows are searched once; then each leaves itself out."""
        x = self.index
        first, same = distinct(rows)
        asked = Rows(np.concatenate(([0], np.cumsum(np.diff(rows.start)[first]))), *(v[tb.ranges(rows.start[first], np.diff(rows.start)[first])] for v in (rows.places, rows.values)))
        query, point, cosine = x.nearest(asked.weighted(self.weights), k + 1)
        begin = np.searchsorted(query, np.arange(len(first) + 1))
        count = np.diff(begin)[same]
        at = tb.ranges(begin[:-1][same], count)
        query, point, cosine = np.repeat(np.arange(len(rows)), count), point[at], cosine[at]
        mine = tb.member(own, x.ids)
        itself = (mine[query] >= 0) & (x.point_of[np.maximum(mine[query], 0)] == point) if len(x.ids) else np.zeros(len(query), bool)
        n = x.n[point] - itself
        bad = x.bad[point] - (itself * x.toxic_of[np.maximum(mine[query], 0)] if len(x.ids) else 0)
        query, point, cosine, n, bad = (v[n > 0] for v in (query, point, cosine, n, bad))
        before = np.cumsum(n) - n
        start = np.searchsorted(query, np.arange(len(rows) + 1))
        before -= before[start[:-1][query]] if len(query) else 0
        seats = np.clip(k - before, 0, n)
        query, point, cosine, n, bad, seats = (v[seats > 0] for v in (query, point, cosine, n, bad, seats))
        return Neighbours(np.searchsorted(query, np.arange(len(rows) + 1)), point, cosine, n, bad, seats)


def _vectors(df: DataFrame, known: np.ndarray, beside: str) -> DataFrame:
    """doc_id, one more column, and the packed counts of the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.texts_of(batch["text"]).chunks():
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part[beside], *packed_rows(counted(texts, known))], ["doc_id", beside, "places", "counts"])

    kind = dict(df.dtypes)[beside]
    return df.select("doc_id", beside, "text").mapInArrow(run, f"doc_id long, {beside} {kind}, places binary, counts binary")


def examples_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text): at most `sample` rows, one an id."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id").limit(sample)  # the bound that allows the broadcast below
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def telling_terms(examples: DataFrame) -> np.ndarray:
    """Hashes, ascending, of the terms whose presence depends most on the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy()
            for a, b, texts in tb.texts_of(batch["text"]).chunks():
                text, term = terms_of(texts)
                order = np.lexsort((text, term))
                text, term = text[order], term[order]
                once = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (text[1:] != text[:-1]))))
                often = once[np.diff(np.append(once, len(term))) > 1]
                names, at = np.unique(np.concatenate((term[once], term[often] ^ AGAIN)), return_inverse=True)
                bad = np.bincount(at, toxic[a:b][np.concatenate((text[once], text[often]))], len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(names)) - bad)], ["term", "bad", "good"])

    n = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    bad, good, n1, n0 = F.col("bad"), F.col("good"), float(n.get(1, 0)), float(n.get(0, 0))
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    pull = lambda seen, of, share: F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)
    share = (bad + good) / (n1 + n0)
    ratio = 2 * (pull(bad, n1, share) + pull(good, n0, share) + pull(n1 - bad, n1, 1 - share) + pull(n0 - good, n0, 1 - share))
    counts = examples.select("toxic", "text").mapInArrow(run, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rates = bad / n1, good / n0
    apart = F.greatest(*rates) >= LEAST_LIFT * F.least(*rates)
    told = counts.where((bad + good >= LEAST_EXAMPLES) & (bad + good < n1 + n0) & apart).select("term", F.round(ratio, 6).alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    rows = told.orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).collect()
    return np.sort(np.array([r["term"] for r in rows], np.int64).view(np.uint64))


def document_frequencies(vectors: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Documents, and those with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            df += np.bincount(unpacked_rows(batch).places, minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, np.flatnonzero(df))), pa.array(np.append(n, df[df > 0]))], ["place", "n"])

    got = vectors.select("places", "counts").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # a row a term
    n = {r["place"]: r["n"] for r in got}
    return n.get(-1, 0), np.array([n.get(k, 0) for k in range(width)], np.float64)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number: Column = F.col(f"`{id_col}`").cast("long")
    return docs.select(number.alias("doc_id"), held_out(number).alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _own(batch: pa.RecordBatch) -> np.ndarray:
    return batch["doc_id"].fill_null(tb.NULL_ID).to_numpy()


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the neighbours, nearest first) of each document."""
    docs = _narrow(docs, id_col, text_col)
    examples = tb.checkpointed(examples_of(docs, labels, sample))
    known = telling_terms(examples)
    vectors = tb.checkpointed(_vectors(docs, known, "held_out"))
    n, df = document_frequencies(vectors, len(known))
    weights = np.log((1 + n) / (1 + df)) + 1
    rows = _vectors(examples, known, "toxic").toArrow().sort_by("doc_id")  # at most `sample` rows
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    index = Index(unpacked_rows(rows), rows["doc_id"].to_numpy(), toxic, weights)
    model = Model(known, weights, index, Calibration.of(np.zeros(0), np.zeros(0)))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.neighbours(unpacked_rows(batch), _own(batch)).votes()), batch["toxic"]], ["vote", "toxic"])

    seen = _vectors(examples, known, "toxic").mapInArrow(votes, "vote double, toxic int").toArrow()  # at most `sample` rows
    fitted = Model(known, weights, index, Calibration.of(seen["vote"].to_numpy(), seen["toxic"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = fitted.neighbours(unpacked_rows(batch), _own(batch))
            p = fitted.calibration(near.votes())
            cells = pa.StructArray.from_arrays([pa.array(v) for v in (index.least[near.point], near.cosine, near.n, near.bad)], ["doc_id", "similarity", "examples", "toxic"])
            evidence = pa.ListArray.from_arrays(near.start.astype(np.int32), cells)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= TOXIC).astype(np.int32)), evidence.cast(_EVIDENCE)], schema=_SCHEMA)

    return vectors.mapInArrow(run, RESULT)
