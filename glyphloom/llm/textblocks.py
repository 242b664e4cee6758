"""Shared plumbing: texts as byte arrays, word hashes, and the block exchange.

A corpus-wide operator deals documents into *blocks* of about a megabyte by a hash of
id and text.  A block never holds a key's rows together, so no key can make it large; only
rows alike in both id and text come to one block together.  What blocks need to know of each other travels as packed arrays of hashes: each block
first reduces its own repetitions, so a key that a third of all rows share costs one
entry a block.  Every function that runs on a block orders its rows by (id, text hash)
first; a block that is computed again, after a lost executor or for a later step, is
therefore equal to the first one, and rows can be named by their place in it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEGABYTE = 1 << 20
NULL_ID = np.iinfo(np.int64).min

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder, which the driver and all executors can reach; a temporary one only on a single machine, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder."""
    shared_folder(df)
    return df.checkpoint()


class Written:
    """Tables written in the shared folder; unlike checkpoints they carry no derived predicates from round to round.

    Their rows may hold long packed arrays, so few of them go to Python at once.
    """

    def __init__(self, df: DataFrame):
        self.top, self.n = f"{shared_folder(df)}/tables-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(rows)
        conf.set(rows, "500")
        try:
            df.write.option("parquet.block.size", 16 * MEGABYTE).parquet(f"{self.top}/{self.n}")
        finally:
            conf.set(rows, before)
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.top}/{self.n}")

    def forget(self, spark) -> None:
        """Delete all of them."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- texts as arrays


@dataclass
class Texts:
    """UTF-8 texts end to end: text i is data[start[i]:start[i + 1]]."""

    data: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i + 1]].tobytes()

    def chunks(self, limit: int = MEGABYTE) -> Iterator[tuple[int, int, Texts]]:
        """Runs of whole texts of about `limit` bytes, to bound temporary arrays."""
        first = 0
        while first < len(self):
            end = int(np.searchsorted(self.start, self.start[first] + limit, "right")) - 1
            end = min(max(end, first + 1), len(self))
            a, b = self.start[first], self.start[end]
            yield first, end, Texts(self.data[a:b], self.start[first : end + 1] - a)
            first = end


def texts_of(column: pa.ChunkedArray | pa.Array) -> Texts:
    """A string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.cast(pa.large_string()).chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(all_bytes[start[0] : start[-1]], start - start[0])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def space_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of [\\x20\\x09-\\x0D]; no other UTF-8 character contains one."""
    return (data == 32) | ((data >= 9) & (data <= 13))


@dataclass
class Words:
    """Word w of all is data[begin[w]:end[w]]; text i has words first[i] to first[i + 1]."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def split_words(texts: Texts, gap: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes outside `gap` (white space by default), text by text."""
    data, start = texts.data, texts.start
    word = ~(space_mask(data) if gap is None else gap)
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    cut = np.zeros(len(data) + 1, bool)
    cut[start] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    begin = np.flatnonzero(word & (~before | cut[:-1]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return Words(begin, end, np.searchsorted(begin, start))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (a well known 64-bit finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(words.begin):
        return np.zeros(0, np.uint64)
    length = words.end - words.begin
    whole = np.concatenate(([0], np.cumsum(length)))
    inside = np.arange(whole[-1]) - np.repeat(whole[:-1], length)
    at = inside + np.repeat(words.begin, length)
    coded = BYTE_CODES[data[at]] * powers(BASE, int(length.max()))[inside]
    return mix(np.add.reduceat(coded, whole[:-1]) + length.astype(np.uint64) * STEPS[63])


def hash_windows(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every `size` consecutive items, by joining windows of doubled size; windows may cross texts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width = None, 0, h ^ STEPS[32 + salt], 1
    while True:
        if size & width:
            piece = part[done : done + n]
            out = piece if out is None else mix(out * STEPS[salt] + piece)
            done += width
        if done == size:
            return mix(out + np.uint64(size))
        part = mix(part[:-width] * STEPS[16 + salt] + part[width:])
        width *= 2


def inside_texts(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of `size` items that lie in one text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1], count)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    whole = np.cumsum(count) - count
    return np.arange(total) + np.repeat(begin - whole, count)


def spread(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n items a window of `size` items at one of the starts covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each x in an ascending array, or -1."""
    if not len(ordered):
        return np.full(len(x), -1)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == x, at, -1)


# ---------------------------------------------------------------- blocks


@dataclass
class Blocks:
    """Documents with a block number, and their size."""

    docs: DataFrame  # block long, id long, h long, text string, and further columns
    n_blocks: int
    total: int

    def groups(self, n_bytes: float) -> int:
        """How many groups of at most about 16 MB hold so many bytes."""
        return max(16, int(n_bytes / (16 * MEGABYTE)) + 1)


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None) -> Blocks:
    """Deal documents into blocks by a hash of id and text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    total, n = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    size = min(max(MEGABYTE, (total or 0) // 8192), 8 * MEGABYTE)
    n_blocks = max(1, (total or 0) // size + n // 20_000)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), *[c.alias(k) for k, c in (extra or {}).items()])
    block = F.pmod(F.xxhash64(F.lit(11), "id", "h"), F.lit(n_blocks))
    return Blocks(chosen.select(block.alias("block"), "*"), int(n_blocks), int(total or 0))


@dataclass
class Block:
    number: int
    ids: np.ndarray  # a null id counts as the smallest
    hashes: np.ndarray
    texts: Texts
    table: pa.Table


def block_of(table: pa.Table) -> Block:
    """A block's rows in their fixed order."""
    ids = table["id"].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    hashes = table["h"].combine_chunks().to_numpy(zero_copy_only=False)
    order = np.lexsort((hashes, ids))
    table = table.take(pa.array(order)) if len(order) > 1 else table
    number = table["block"][0].as_py() if table.num_rows else -1
    return Block(number, ids[order], hashes[order], texts_of(table["text"]), table)


class WholeRows:
    """Carries a table's columns through blocks: the text by its own column, the rest in a struct that is read by position."""

    def __init__(self, docs: DataFrame, text_col: str):
        self.columns, self.text_col, self.schema = list(docs.columns), text_col, docs.schema
        self.others = [c for c in self.columns if c != text_col]

    def struct(self):
        return F.struct(F.col(f"`{self.text_col}`").isNotNull(), *[F.col(f"`{c}`") for c in self.others])

    def columns_of(self, table: pa.Table, texts: list[str] | None = None) -> dict[str, pa.Array]:
        """The table's own columns again, with other texts if given; a null text stays null."""
        row = table["row"].combine_chunks()
        own = {c: row.field(k + 1) for k, c in enumerate(self.others)}
        texts = texts or table["text"].to_pylist()
        own[self.text_col] = pa.array([t if had else None for t, had in zip(texts, row.field(0).to_pylist())], pa.string())
        return {c: own[c] for c in self.columns}

    def empty(self) -> pa.Table:
        return pa.table({c: pa.array([], pa.null()) for c in self.columns})


def packed(**arrays: np.ndarray) -> dict[str, bytes]:
    return {k: v.tobytes() for k, v in arrays.items()}


def unpacked(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Binary cells that hold arrays, end to end."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def lengths(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.array([len(x.as_buffer()) for x in column], np.int64) // np.dtype(dtype).itemsize


def dealt(number: np.ndarray, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(group number, places of its members) for each number that occurs; places ascend."""
    order = np.argsort(number, kind="stable") if order is None else order
    if not len(order):
        return
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    for part in np.split(order, cuts):
        yield int(number[part[0]]), part


REPEATED = "block long, keys binary, counts binary"
SENT = "bucket long, block long, keys binary, counts binary"


def repeated_keys(blocks: Blocks, keys_of, bytes_each: float, beside: DataFrame | None = None) -> tuple[DataFrame, int]:
    """For each block, those of its keys that occur at least twice in all blocks, with their counts.

    keys_of(block) gives 64-bit keys, ascending and distinct, and how often each occurs in
    the block.  A key is known by 32 of its bits and by its bucket; another key with the
    same bits adds to its count, so counts are upper bounds, the same for all blocks.
    bytes_each: about how many bytes of keys come from a byte of text.
    beside: rows with a block number that keys_of(block, rows) needs too.
    Returns (block, keys, counts) and the number of buckets.
    """
    n_buckets = blocks.groups(blocks.total * bytes_each)

    def send(table: pa.Table, *more: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": [], "block": [], "keys": [], "counts": []})
        block = block_of(table)
        keys, counts = keys_of(block, *more)
        rows = {"bucket": [], "block": [], "keys": [], "counts": []}
        for b, at in dealt((keys % np.uint64(n_buckets)).astype(np.int64)):
            rows["bucket"].append(b)
            rows["block"].append(block.number)
            rows["keys"].append((keys[at] >> np.uint64(32)).astype(np.uint32).tobytes())
            rows["counts"].append(np.minimum(counts[at], 2**32 - 1).astype(np.uint32).tobytes())
        return pa.table(rows, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        keys, counts = unpacked(table["keys"], np.uint32), unpacked(table["counts"], np.uint32)
        bucket = table["bucket"][0].as_py()
        n = lengths(table["keys"], np.uint32)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.add.reduceat(counts[order].astype(np.int64), head)
        of_key = np.empty(len(keys), np.int64)
        of_key[order] = np.repeat(total, np.diff(np.append(head, len(keys))))
        rows = {"block": [], "keys": [], "counts": []}
        for number, a, b in zip(table["block"].to_pylist(), np.cumsum(n) - n, np.cumsum(n)):
            often = np.flatnonzero(of_key[a:b] >= 2) + a
            if len(often):
                rows["block"].append(number)
                rows["keys"].append((keys[often].astype(np.uint64) << np.uint64(32) | np.uint64(bucket)).tobytes())
                rows["counts"].append(np.minimum(of_key[often], 2**32 - 1).astype(np.uint32).tobytes())
        return pa.table(rows, pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    by_block = blocks.docs.groupBy("block")
    if beside is None:
        sent = by_block.applyInArrow(lambda table: send(table), SENT)
    else:
        sent = by_block.cogroup(beside.groupBy("block")).applyInArrow(lambda left, right: send(left, right), SENT)
    return sent.groupBy("bucket").applyInArrow(count, REPEATED), n_buckets


def counts_in(keys: np.ndarray, table: pa.Table, n_buckets: int) -> np.ndarray:
    """The counts that repeated_keys gave this block for the keys; 1 where it gave none."""
    known, counts = unpacked(table["keys"], np.uint64), unpacked(table["counts"], np.uint32)
    order = np.argsort(known)
    short = (keys >> np.uint64(32) << np.uint64(32)) | (keys % np.uint64(n_buckets))
    at = member(short, known[order])
    return np.where(at >= 0, counts[order][at] if len(counts) else 1, 1).astype(np.int64)
