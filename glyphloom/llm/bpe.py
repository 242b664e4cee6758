"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A text is cut by the tokenizer's pattern; each match is merged separately, as tiktoken
does: a match that is itself a token is that token; otherwise the pair of neighbours with
the lowest rank, leftmost of equals, becomes one token, until no pair has a rank.

The tree's leaves are the byte positions.  The leaf of a live part holds the rank of its
pair with the next live part together with its position, so the root is the leftmost
minimum.  A merge kills the right part's leaf and renews two others, the merged part's
and its left neighbour's; each is a point update along one path to the root.  Matches of
like length are merged together, one tree to a row of a matrix; long ones (a text of one
word, say) get a tree of their own, so a match of n bytes takes O(n log n).

Null and empty texts have no tokens.  Other columns are carried along; rows are
independent, so repeated rows, ties and order do not matter.  A name in use already is
an error for encode() and decode(), not for digests().  An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textblocks as tb

NONE = np.iinfo(np.int64).max
SHORT = 64
CACHED = 400_000


class Vocabulary:
    """The ranks of a .tiktoken file; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        for t, r in self.rank.items():
            self.token[r] = t
        pairs = {}
        for t, r in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.pair_rank = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair (a, b); NONE where it has none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def text(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        return self.blob[tb.ranges(self.begin[ids], self.length[ids])]

    # -- merging

    def merge_long(self, piece: bytes) -> list[int]:
        """One match of any length, in a tree of its own."""
        n = len(piece)
        width = 1 << max(n - 1, 0).bit_length()
        part = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        none, size, pair = NONE, self.size, self.pair_rank.get
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            j = nxt[i]
            r = pair(part[i] * size + part[j]) if j < n else None
            return none if r is None else r * width + i

        def update(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        for i in range(n):
            tree[width + i] = leaf(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] != none:
            r, i = divmod(tree[1], width)
            gone = nxt[i]
            part[i], nxt[i] = r, nxt[gone]
            if nxt[i] < n:
                prv[nxt[i]] = i
            update(gone, none)
            update(i, leaf(i))
            if prv[i] >= 0:
                update(prv[i], leaf(prv[i]))
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = nxt[i]
        return out

    def merge_short(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Matches of at most `width` bytes: all ids end to end, and how many each has."""
        n, lanes = len(begin), np.arange(len(begin))
        place = np.arange(width)
        live = place < length[:, None]
        part = np.full((n, width + 1), -1, np.int64)
        part[:, :width][live] = self.of_byte[data[tb.ranges(begin, length)]]
        nxt = np.minimum(place + 1, length[:, None])
        nxt = np.where(nxt < length[:, None], nxt, width)
        prv = np.where(place > 0, place - 1, width) * np.ones((n, 1), np.int64)
        prv = np.concatenate((prv, np.zeros((n, 1), np.int64)), 1)
        tree = np.full((n, 2 * width), NONE)
        at = np.nonzero(live[:, 1:])
        found = self.ranks(part[at], part[at[0], at[1] + 1])
        tree[at[0], width + at[1]] = np.where(found < NONE, found * width + at[1], NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def update(lane: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            i = i + width
            tree[lane, i] = value
            while i[0] > 1:
                i = i >> 1
                tree[lane, i] = np.minimum(tree[lane, 2 * i], tree[lane, 2 * i + 1])

        def leaf(lane: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = nxt[lane, i]
            found = self.ranks(part[lane, i], part[lane, j])
            return np.where((j < width) & (found < NONE), found * width + i, NONE)

        lane = lanes[tree[:, 1] < NONE]
        while len(lane):
            r, i = np.divmod(tree[lane, 1], width)
            gone = nxt[lane, i]
            after = nxt[lane, gone]
            part[lane, i] = r
            part[lane, gone] = -1
            nxt[lane, i] = after
            prv[lane, after] = i
            update(lane, gone, np.full(len(lane), NONE))
            update(lane, i, leaf(lane, i))
            left = prv[lane, i]
            has = left < width
            if has.any():
                some, left = lane[has], left[has]
                update(some, left, leaf(some, left))
            lane = lane[tree[lane, 1] < NONE]
        kept = part[:, :width] >= 0
        return part[:, :width][kept], kept.sum(1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and where each piece's begin and end: n + 1 places."""
        length = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(length) - length
        whole = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        count = np.ones(len(pieces), np.int64)
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = whole < 0
        low, width = 0, 8
        while width <= SHORT:
            chosen = np.flatnonzero(todo & (length > low) & (length <= width))
            for part in np.array_split(chosen, max(1, len(chosen) * width // 250_000)):
                if len(part):
                    ids, n = self.merge_short(data, begin[part], length[part], width)
                    count[part] = n
                    made.append((part, ids, n))
            low, width = width, width * 2
        for i in np.flatnonzero(todo & (length > SHORT)).tolist():
            ids = np.array(self.merge_long(pieces[i]), np.int64)
            count[i] = len(ids)
            made.append((np.array([i]), ids, count[i : i + 1]))
        place = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(place[-1], np.int64)
        out[place[:-1][~todo]] = whole[~todo]
        for part, ids, n in made:
            out[tb.ranges(place[part], n)] = ids
        return out, place


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Places(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Texts to ids; merges each distinct match once as long as it is remembered."""

    def __init__(self, merge, pattern: str, cached: int = CACHED):
        self.merge, self.find, self.cached = merge, regex.compile(pattern).findall, cached
        self.forget()

    def forget(self) -> None:
        self.places, self.ids, self.place, self.done = _Places(), np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 places."""
        if len(self.places) > self.cached:
            self.forget()
        numbers, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.find(text)
            counts[i] = len(found)
            numbers.append(np.fromiter(map(self.places.__getitem__, found), np.int64, len(found)))
        new = len(self.places) - self.done
        if new:
            fresh = [*islice(reversed(self.places), new)][::-1]
            ids, place = self.merge([x.encode() for x in fresh])
            self.place = np.concatenate((self.place, place[1:] + len(self.ids)))
            self.ids = np.concatenate((self.ids, ids))
            self.done = len(self.places)
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        n = self.place[number + 1] - self.place[number]
        ends = np.concatenate(([0], np.cumsum(n)))
        return self.ids[tb.ranges(self.place[number], n)], ends[np.concatenate(([0], np.cumsum(counts)))]


def _slices(table: pa.RecordBatch, column: str, limit: int = tb.MEGABYTE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with about `limit` bytes of text."""
    texts = tb.texts_of(table[column])
    for a, b, _ in texts.chunks(limit):
        part = table.slice(a, b - a)
        yield part, [x or "" for x in part[column].to_pylist()]


def _arrays(ids: np.ndarray, place: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name} already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """docs with their token ids as array<int>; path names a .tiktoken file that executors can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path).merge, pattern)
        for batch in batches:
            for part, texts in _slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, _arrays(*encoder.encode(texts))], [*part.schema.names, to])

    return docs.mapInArrow(run, _added(docs, to, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the bytes of their token ids (null: empty); an id out of range is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            made = [words.text(np.array(x or [], np.int64)).tobytes() for x in batch[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, to])

    return docs.mapInArrow(run, _added(docs, to, T.BinaryType()))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, the hash of its ids, and the hash of the bytes that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        encoder = Encoder(words.merge, pattern)
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                ids, place = encoder.encode(texts)
                stored, at = ids.astype("<u4").tobytes(), (place * 4).tolist()
                back = words.text(np.frombuffer(stored, "<u4")).tobytes()
                ends = np.concatenate(([0], np.cumsum(words.length[ids])))[place].tolist()
                n = range(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"], pa.array(np.diff(place)),
                        pa.array([hashlib.sha256(stored[at[i] : at[i + 1]]).hexdigest() for i in n], pa.string()),
                        pa.array([hashlib.sha256(back[ends[i] : ends[i + 1]]).hexdigest() for i in n], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
