"""Benchmark decontamination by spaced seeds that tolerate substituted words.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A mask is a
fixed set of places in a span; the hash of the words at these places ignores the others.
Two masks of six places are used that, together, miss no pair of 13-word stretches with at
most two words substituted.  Shorter items and other limits have masks of their own: the
stretch is cut into groups, one or two more than the words that may differ, and a mask
leaves out as many groups as words may differ, so one mask meets none of them.  Hashes of all masks at all places of the benchmark are looked
up from every place of every document.  Around each hit, document and item are laid side
by side and every stretch of `stretch` words (or the whole item, if that is shorter) is
compared: it counts as copied if at least `equal_percent` of its words agree.

Items of fewer than `least` words count as copied only if all their words stand in a row.
Null and empty texts hit nothing.  A null item_id is carried as it is.  Repeated rows of
either table are judged each for itself: one row is returned for each pair of a document
row and an item row.  Other columns are not read by `find_copies` and are carried along by
`keep_clean`.  Either table may be empty.

A benchmark of at most `block_bytes` of text goes to the tasks as it is.  A larger one is
cut into blocks of that size by a hash of its rows and written in the shared folder; a task
reads one block after the other for every `HELD` bytes of documents, so documents are read
once, and neither the driver nor a task ever holds more than a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
RESULT = "doc_id long, item_id long, n_item_words long, n_copied long, n_equal long, doc_word long, item_word long"


def _tokens(texts: tb.Texts) -> tuple[tb.Words, np.ndarray]:
    data = tb.lower_ascii(texts.data)
    keeps = np.zeros(256, bool)
    keeps[48:58] = keeps[97:123] = keeps[128:] = True
    words = tb.split_words(tb.Texts(data, texts.start), ~keeps[data])
    return words, tb.hash_words(data, words)


def _seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(len(hashes) - mask[-1], 0)
    out = np.full(n, tb.STEPS[40], np.uint64)
    for k, place in enumerate(mask):
        out = out * tb.STEPS[41 + k % 23] + hashes[place : place + n]
    return tb.mix(out)


def _masks(size: int, lost: int) -> list[tuple[int, tuple[int, ...]]]:
    """(span, mask): two stretches of `size` words of which at most `lost` differ agree on one of the masks."""
    if size >= 13 and lost <= 2:
        return [(mask[-1] + 1, mask) for mask in MASKS]
    if not lost:
        return [(size, tuple(range(size)))]
    # `lost` words touch at most as many groups; two groups at once are rarer in the documents than one
    kept = 2 if lost <= 2 and size >= lost + 2 else 1
    groups = np.array_split(np.arange(size), lost + kept)
    return [(size, tuple(np.concatenate(g).tolist())) for g in combinations(groups, kept)]


class Items:
    """The words of some benchmark items and the seeds at all their places."""

    def __init__(self, rows: list[tuple[int | None, str | None]], stretch: int, equal_percent: int, least: int):
        column = pa.array([t or "" for _, t in rows], pa.large_string())
        self.words, self.hashes = _tokens(tb.texts_of(column))
        self.ids = [i for i, _ in rows]
        self.length = np.diff(self.words.first)
        self.short = self.length < least
        self.size = np.where(self.short, self.length, np.minimum(stretch, self.length))
        self.equal = np.where(self.short, self.size, -(-equal_percent * self.size // 100))
        self.seeds = []
        kinds = np.stack((self.size, self.size - self.equal, self.short), 1)
        for size, lost, short in np.unique(kinds[self.size > 0], axis=0).tolist():
            chosen = (kinds == (size, lost, short)).all(1)
            for span, mask in _masks(size, lost):
                at = tb.inside_texts(self.words.first, span)
                at = at[np.repeat(chosen, np.maximum(self.length - span + 1, 0))]
                key = _seeds(self.hashes, mask)[at]
                order = np.argsort(key)
                some = np.zeros(1 << 16, bool)
                some[(key >> np.uint64(48)).astype(np.int64)] = True
                self.seeds.append((span, mask, bool(short), key[order], at[order], some))

    def copies(self, texts: tb.Texts) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, words copied, equal among them, first word in text, in item), the best for each pair."""
        words, hashes = _tokens(texts)
        pairs = []
        for span, mask, short, keys, at, some in self.seeds:
            starts = tb.inside_texts(words.first, span)
            if not len(starts):
                continue
            found = _seeds(hashes, mask)[starts]
            maybe = some[(found >> np.uint64(48)).astype(np.int64)]
            found, starts = found[maybe], starts[maybe]
            low = np.searchsorted(keys, found)
            n = np.searchsorted(keys, found, "right") - low
            place = np.repeat(starts, n)
            item_place = at[tb.ranges(low, n)]
            doc = np.searchsorted(words.first, place, "right") - 1
            item = np.searchsorted(self.words.first, item_place, "right") - 1
            met = np.stack((doc, item, place - words.first[doc] - item_place + self.words.first[item]), 1)
            if short and len(met):
                # all places of a whole item are as good; the last one stands for them
                met = met[np.lexsort((met[:, 2], met[:, 1], met[:, 0]))]
                met = met[np.append((met[1:, :2] != met[:-1, :2]).any(1), True)]
            pairs.append(met)
        best: dict[tuple[int, int], tuple[int, ...]] = {}
        for doc, item, shift in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else ():
            a, n = words.first[doc], words.first[doc + 1] - words.first[doc]
            b, m = self.words.first[item], self.length[item]
            low, high = max(0, -shift), min(m, n - shift)
            size = int(self.size[item])
            if high - low < size:
                continue
            equal = hashes[a + low + shift : a + high + shift] == self.hashes[b + low : b + high]
            total = np.concatenate(([0], np.cumsum(equal)))
            near = np.flatnonzero(total[size:] - total[:-size] >= self.equal[item])
            if len(near):
                covered = tb.spread(near, size, len(equal))
                first = low + int(near[0])
                got = (int(covered.sum()), int((covered & equal).sum()), first + shift, first)
                best[doc, item] = max(best.get((doc, item), got), got)
        return [(*k, *v) for k, v in sorted(best.items())]


HELD = 16 * tb.MEGABYTE


@lru_cache(2)
def _block(folder: str, stretch: int, equal_percent: int, least: int) -> Items:
    """The items of a written block."""
    system, top = pyarrow.fs.FileSystem.from_uri(folder)
    names = [f.path for f in system.get_file_info(pyarrow.fs.FileSelector(top, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [row for name in sorted(names) for row in pyarrow.parquet.read_table(system.open_input_file(name), columns=["item_id", "text"]).to_pylist()]
    return Items([(r["item_id"], r["text"]) for r in rows], stretch, equal_percent, least)


def _blocks(benchmark: DataFrame, block_bytes: int, stretch: int, equal_percent: int, least: int) -> list[Callable[[], Items]]:
    """What gives a task the items, so many bytes of them at a time."""
    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        rows = [(r.item_id, r.text) for r in chosen.collect()]
        items = Items(rows, stretch, equal_percent, least)
        return [lambda: items] if rows else []
    n = total // block_bytes + 1
    folder = f"{tb.shared_folder(benchmark)}/items-{uuid.uuid4().hex}"
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part")
    chosen.select(number, "*").repartition(F.col("part")).write.partitionBy("part").parquet(folder)
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return [lambda k=k: _block(f"{folder}/part={k}", stretch, equal_percent, least) for k in range(n)]


def _searched(batches: Iterator[pa.RecordBatch], blocks: list[Callable[[], Items]]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with its (row, item_id, item's words, ...), blocks in turn for about HELD bytes of documents."""

    def search(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        made: list[list[tuple]] = [[] for _ in held]
        for block in blocks:
            items = block()
            for batch, rows in zip(held, made):
                for a, _, texts in tb.texts_of(batch["text"]).chunks():
                    rows += [(a + d, items.ids[i], int(items.length[i]), *rest) for d, i, *rest in items.copies(texts)]
        yield from zip(held, made)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch["text"].nbytes
        if size > HELD:
            yield from search(held)
            held, size = [], 0
    yield from search(held)


def find_copies(docs: DataFrame, benchmark: DataFrame, stretch: int = 13, equal_percent: int = 80, least: int = 8, block_bytes: int = 4 * tb.MEGABYTE) -> DataFrame:
    """One row for each document and item of which it holds a copied stretch."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_item_words", "n_copied", "n_equal", "doc_word", "item_word")])
    blocks = _blocks(benchmark, block_bytes, stretch, equal_percent, least)
    if not blocks:
        return docs.sparkSession.createDataFrame([], RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _searched(batches, blocks):
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[d], *rest) for d, *rest in made]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, stretch: int = 13, equal_percent: int = 80, least: int = 8, block_bytes: int = 4 * tb.MEGABYTE) -> DataFrame:
    """The documents without a copied stretch, with all their columns."""
    blocks = _blocks(benchmark, block_bytes, stretch, equal_percent, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _searched(batches, blocks):
            clean = np.ones(batch.num_rows, bool)
            clean[[d for d, *_ in made]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema) if blocks else docs
