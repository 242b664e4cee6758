"""Terms of a lexicon table in texts: leftmost first, the longest of those that begin at one place.

Windows of a text that are as long as some term, and begin as some term does, are hashed at
once by differences of prefix sums; a bitmap and a sorted array leave the few that may be
terms, and these are compared letter by letter.  Within the stated size the lexicon goes to
all tasks, as arrays of about nine bytes and the letters a term.  Beyond it
distinct texts are dealt into blocks: a block sends each window that passes a bitmap of all
terms once, however often it holds it, a join keeps those that are terms, and they come back
to the block.  Both ways give the same.

Null texts have no terms and stay null; empty and null terms do not count; equal rows are
treated alike.  Lengths are in code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError

MOST_BROADCAST = 32 << 20  # characters of all terms
BLOCK = 1 << 20  # characters of text
MOST_BITS = 30  # of a place in the bitmap of all terms beyond that
HEAD = 4  # characters that terms begin with
_HEAD_BITS = 22
_HEAD_SHIFT = np.uint64(64 - _HEAD_BITS)
_PAGE = 15  # bits of a place in a page of a bitmap
_BASE = 0x9E3779B97F4A7C15
_BETWEEN = 0x110000  # no code point


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a separator after each, and where texts begin."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
    codes = np.full(begin[-1], _BETWEEN, np.uint32)
    for p, at in zip(parts, begin):
        codes[at : at + len(p)] = p
    return codes, begin


class Windows:
    """Hashes of all windows of a code array."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * power[:n], dtype=np.uint64)))
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            self.back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))))

    def at(self, at: np.ndarray, size: int) -> np.ndarray:
        """The hashes of the windows of a size at these places, none of which reaches beyond the end."""
        with np.errstate(over="ignore"):
            h = (self.sums[at + size] - self.sums[at]) * self.back[at]
            return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def heads(self, bits: np.ndarray) -> np.ndarray:
        """Where a head of a term may begin."""
        h = self.at(np.arange(max(len(self.sums) - HEAD, 0)), HEAD)
        return np.flatnonzero(_has(bits, (h >> _HEAD_SHIFT).astype(np.int64)))

    def places(self, heads: np.ndarray | None, size: int) -> np.ndarray:
        """Where a term of a size may begin: terms shorter than a head anywhere."""
        n = max(len(self.sums) - size, 0)
        return np.arange(n) if size < HEAD else heads[: np.searchsorted(heads, n)]


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places of a packed bitmap are set."""
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def _packed(places: np.ndarray, n_bits: int) -> np.ndarray:
    bits = np.zeros(1 << n_bits, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little")


def _hashed(terms: list[str]):
    """(rows, size, hashes, places of heads, code points a row) of the terms of each size."""
    codes, begin = _codes(terms)
    windows, sizes = Windows(codes), np.diff(begin) - 1
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        at = begin[rows]
        heads = (windows.at(at, HEAD) >> _HEAD_SHIFT).astype(np.int64) if size >= HEAD else np.zeros(0, np.int64)
        yield rows, size, windows.at(at, size), heads, codes[at[:, None] + np.arange(size)]


class Terms:
    """A set of terms to look for: sorted hashes and letters in arrays, so that many processes may hold it."""

    def __init__(self, terms):
        """terms: lists of terms; each list is taken by blocks."""
        found: dict[int, list] = {}
        heads = np.zeros(1 << _HEAD_BITS, bool)
        for some in terms:
            for a, b in _batches(some):
                for _, size, keys, at, letters in _hashed([t for t in some[a:b] if t]):
                    letters = letters.astype(np.min_scalar_type(int(letters.max())))
                    found.setdefault(size, []).append((keys, letters))
                    heads[at] = True
        self.heads = np.packbits(heads, bitorder="little")
        self.by_size = {}
        for size in sorted(found, reverse=True):
            parts = found.pop(size)
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys)
            self.by_size[size] = keys[order], np.concatenate([x for _, x in parts])[order]
        n = sum(len(keys) for keys, _ in self.by_size.values())
        bits = max(16, min(26, (16 * n).bit_length()))
        self.shift = np.uint64(64 - bits)
        every = [keys for keys, _ in self.by_size.values()]
        self.maybe = _packed((np.concatenate([np.zeros(0, np.uint64), *every]) >> self.shift).astype(np.int64), bits)

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """For each place the size of the longest term that begins there, or 0."""
        windows, best = Windows(codes), np.zeros(len(codes), np.int32)
        heads = windows.heads(self.heads)
        for size, (keys, letters) in self.by_size.items():
            at = windows.places(heads, size)
            at = at[best[at] == 0]
            h = windows.at(at, size)
            kept = np.flatnonzero(_has(self.maybe, (h >> self.shift).astype(np.int64)))
            at, h = at[kept], h[kept]
            place = np.searchsorted(keys, h)
            # terms of equal hashes follow each other
            while len(at):
                same = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == h)
                same = same[place[same] < len(keys)]
                at, h, place = at[same], h[same], place[same]
                equal = np.zeros(len(at), bool)
                step = max(1, BLOCK // size)
                for k in range(0, len(at), step):
                    equal[k : k + step] = (codes[at[k : k + step, None] + np.arange(size)] == letters[place[k : k + step]]).all(1)
                best[at[equal]] = size
                at, h, place = at[~equal], h[~equal], place[~equal] + 1
        return best

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, size) of the terms of each text, none of which overlap."""
        codes, begin = _codes(texts)
        best = self.longest(codes)
        starts = np.flatnonzero(best)
        ends = starts + best[starts]
        following = np.searchsorted(starts, ends).tolist()
        bounds = np.searchsorted(starts, begin).tolist()
        out = []
        for k in range(len(texts)):
            i, found = bounds[k], []
            while i < bounds[k + 1]:
                found.append((int(starts[i] - begin[k]), int(best[starts[i]])))
                i = following[i]
            out.append(found)
        return out


def _batches(texts: list[str | None]):
    """Slices of about a block's characters."""
    a, n = 0, 0
    for b, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= BLOCK:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _wrapped(text: str, spans, tag: str) -> str:
    parts, at = [], 0
    for start, size in spans:
        parts += [text[at:start], f"<{tag}>", text[start : start + size], f"</{tag}>"]
        at = start + size
    return "".join([*parts, text[at:]])


def _found(terms: Terms, texts: list[str | None], tag: str | None):
    """Tagged texts, or lists of spans."""
    out: list = []
    for a, b in _batches(texts):
        here = [t or "" for t in texts[a:b]]
        for t, raw, spans in zip(here, texts[a:b], terms.spans(here) if terms.by_size else [[]] * len(here)):
            if raw is None:
                out.append(None)
            else:
                out.append(_wrapped(t, spans, tag) if tag is not None else [{"start": s, "size": n} for s, n in spans])
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())]))


def _run(docs: DataFrame, text: str, lexicon: DataFrame, term: str, out: str, tag: str | None) -> DataFrame:
    if out in docs.columns:
        raise ArgumentError(f"there is a column {out!r} already")
    terms = lexicon.select(lexicon[f"`{term}`"].cast("string").alias("term")).where("term <> ''").distinct()
    size = terms.agg(F.coalesce(F.sum(F.length("term") + 1), F.lit(0)).alias("n")).first()["n"]
    # plain names inside, since those with dots and the like need care everywhere
    plain, at = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index(text)}"
    added = T.StructField("made", T.StringType() if tag is not None else _SPANS)
    if size <= MOST_BROADCAST:
        shared = docs.sparkSession.sparkContext.broadcast(Terms(chunk.to_pylist() for chunk in _cut(terms.toArrow()["term"])))
        done = plain.mapInArrow(_mapper(shared, at, tag), T.StructType([*plain.schema.fields, added]))
    else:
        found = _by_join(plain.select(F.col(at).alias("text")).where("text is not null").distinct(), terms, tag, added)
        done = plain.join(found, plain[at] == found["text"], "left").drop("text")
    return done.toDF(*docs.columns, out)


def _column(found: list, tag: str | None) -> pa.Array:
    return pa.array(found, pa.string() if tag is not None else pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))


def _mapper(shared, text: str, tag: str | None):
    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(text)):
                piece = batch.slice(a, b - a)
                yield piece.append_column("made", _column(_found(shared.value, piece.column(text).to_pylist(), tag), tag))

    return run


def _slices(column: pa.Array):
    """(from, to) of slices of about a block's bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(ends):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK)) + 1
        yield a, min(b, len(ends))
        a = b


def _cut(column: pa.ChunkedArray):
    for chunk in column.chunks:
        for a, b in _slices(chunk):
            yield chunk.slice(a, b - a)


def _by_join(texts: DataFrame, terms: DataFrame, tag: str | None, added: T.StructField) -> DataFrame:
    """(text, made) of distinct texts; what reaches the driver is a bitmap of stated size and one row a length."""
    bits = max(16, min(MOST_BITS, (16 * terms.count()).bit_length()))
    shift, low = np.uint64(64 - bits), np.uint64((1 << bits) - 1)

    def probes(h: np.ndarray):
        return (h >> shift).astype(np.int64), (h & low).astype(np.int64)

    def places(batches):
        """How long terms are, and which places they take in the bitmap of all terms and in that of heads."""
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                for _, size, keys, heads, _ in _hashed(batch.column(0).slice(a, b - a).to_pylist()):
                    for kind, at in ((0, np.concatenate(probes(keys))), (1, np.unique(heads))):
                        yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(at >> _PAGE), pa.array((at & ((1 << _PAGE) - 1)).astype(np.int32)), pa.array(np.full(len(at), size, np.int32))], ["kind", "page", "place", "size"])

    def page(table: pa.Table) -> pa.Table:
        made = _packed(table["place"].to_numpy(), _PAGE).tobytes()
        return pa.table([table["kind"][:1], table["page"][:1], pa.array([made], pa.binary())], ["kind", "page", "bits"])

    set_bits = terms.mapInArrow(places, "kind int, page long, place int, size int")
    # pages of set bits: their number is bounded by the sizes of the bitmaps
    pages = set_bits.select("kind", "page", "place").groupBy("kind", "page").applyInArrow(page, "kind int, page long, bits binary").toArrow()
    maps = [np.zeros(1 << max(n - 3, 0), np.uint8) for n in (bits, _HEAD_BITS)]
    for kind, k, made in zip(*(pages[c].to_pylist() for c in ("kind", "page", "bits"))):
        part = maps[kind][k << (_PAGE - 3) : (k + 1) << (_PAGE - 3)]
        part[:] = np.frombuffer(made, np.uint8)[: len(part)]
    sizes = sorted(r["size"] for r in set_bits.select("size").distinct().collect())
    shared = texts.sparkSession.sparkContext.broadcast((*maps, sizes))

    total = texts.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(1)).alias("n")).first()["n"]
    blocks = texts.select(F.pmod(F.xxhash64("text"), F.lit(-(-total // BLOCK))).alias("block"), "text")

    def windows(table: pa.Table) -> pa.Table:
        every, heads, sizes = shared.value
        texts = [t for t in table["text"].to_pylist() if t]
        seen: set[str] = set()
        for a, b in _batches(texts):
            here = texts[a:b]
            codes, begin = _codes(here)
            w = Windows(codes)
            heads_at = w.heads(heads)
            for size in sizes:
                at = w.places(heads_at, size)
                first, second = probes(w.at(at, size))
                at = at[_has(every, first) & _has(every, second)]
                k = np.searchsorted(begin, at, "right") - 1
                at, k = at[at + size < begin[k + 1]], k[at + size < begin[k + 1]]
                seen.update(here[j][i : i + size] for j, i in zip(k.tolist(), (at - begin[k]).tolist()))
        return pa.table([pa.array(np.full(len(seen), table["block"][0].as_py() if table.num_rows else 0)), pa.array(sorted(seen), pa.string())], ["block", "term"])

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _found(Terms([right["term"].to_pylist()]), left["text"].to_pylist(), tag)
        return pa.table([left["text"], _column(found, tag)], ["text", "made"])

    held = blocks.groupBy("block").applyInArrow(windows, "block long, term string").join(terms, "term", "left_semi")
    return blocks.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(mark, T.StructType([T.StructField("text", T.StringType()), added]))


def tagged(docs: DataFrame, text: str, lexicon: DataFrame, term: str, tag: str, out: str = "tagged") -> DataFrame:
    """docs with a column in which every term of the lexicon is wrapped in <tag>...</tag>."""
    return _run(docs, text, lexicon, term, out, tag)


def term_spans(docs: DataFrame, text: str, lexicon: DataFrame, term: str, out: str = "spans") -> DataFrame:
    """docs with a column of (start, size), counted from 0, of the terms found."""
    return _run(docs, text, lexicon, term, out, None)
