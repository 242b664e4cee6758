"""Removal of repeated byte strings with suffix arrays.

Each byte covered by a `size`-byte string that also starts elsewhere goes, wherever the
other one is; strings are judged on the input.

Which bytes a shard holds.  Sorting all suffixes of a corpus in one place is out of reach,
and shards cut by document would each have to meet all others.  So shards are cut by
content: every string of `size` bytes has one anchor, the place of the smallest hash of
its 32-byte substrings (leftmost of equals), which depends on the string alone.  Equal
strings have equal anchors at equal offsets.  All strings with one anchor form a *piece*, a
short run of bytes; pieces whose anchor occurs once in all documents hold nothing that
repeats.  The others are dealt to shards by anchor; within a block, equal pieces become one.

In a shard the suffixes of its distinct pieces are sorted by Larsson-Sadakane refinement:
groups of equal prefixes are split by the rank of what follows, doubling the depth, and
groups of one are left alone.  Kasai's walk then gives common prefixes of neighbours, many
stretches of text side by side; a string repeats if it shares `size` bytes with a
neighbour, or if its piece occurs more than once.

An anchor with very many occurrences is cut into several shards.  Each then hands on its
distinct strings as sorted 128-bit keys, dealt by range; a merge task looks every shard's
keys up in all others' by binary search and reports those found twice.

Null and empty texts have no bytes.  A row's place does not matter, so repeated rows, equal
ids and null ids are simply further texts.  Other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb

GRAM = 32
PLACE_BITS = 24
HOT = 4096
START_DEPTH = 7

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


# ---------------------------------------------------------------- pieces


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place; fewer at the end have none."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width = tb.BYTE_CODES[data], 1
    while width < GRAM:
        part = part[:-width] * tb.STEPS[width.bit_length()] + part[width:]
        width *= 2
    return tb.mix(part)


def _least_places(key: np.ndarray, window: int) -> np.ndarray:
    """The smallest key of each `window` consecutive ones, by prefix and suffix minima of blocks."""
    n = len(key) - window + 1
    padded = np.full(-(-len(key) // window) * window, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    grid = padded.reshape(-1, window)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[window - 1 : window - 1 + n])


def pieces(texts: tb.Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string, number of strings) of each piece; places count from the first text's first byte."""
    out = []
    for a, _, part in texts.chunks():
        hashes = gram_hashes(part.data)
        step = (1 << PLACE_BITS) - size
        for low in range(0, max(len(part.data) - size + 1, 0), step):
            some = hashes[low : low + step + size - GRAM]
            high = np.uint64(PLACE_BITS)
            key = (some >> high << high) | np.arange(len(some), dtype=np.uint64)
            if len(some) < size - GRAM + 1:
                continue
            place = (_least_places(key, size - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            start = tb.inside_texts(part.start, size)
            start = start[(start >= low) & (start < low + len(place))] - low
            if not len(start):
                continue
            at = place[start]
            head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
            out.append((some[at[head]], start[head] + low + texts.start[a], np.diff(np.append(head, len(start)))))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places in the order of their suffixes; the suffix at i stops at end[i].  Equal suffixes keep the order of their places."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate((data, np.zeros(START_DEPTH, np.uint8)))
    place = np.arange(n)
    for k in range(START_DEPTH):
        code = np.where(place + k < end, padded[k : k + n] + np.uint64(1), np.uint64(0))
        key = key << np.uint64(9) | code
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    del key
    # a group is named by its first place in the order; 0 stands for what lies beyond an end
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head + 1
    depth = START_DEPTH
    longest = int((end - place).max()) if n else 0
    alone = new & np.concatenate((new[1:], [True]))
    active = np.flatnonzero(~alone)
    while len(active) and depth < longest:
        i = order[active]
        beyond = i + depth
        second = np.where(beyond < end[i], rank[np.minimum(beyond, n - 1)], 0)
        joint = rank[i] * np.int64(n + 2) + second
        # ties keep the places' order: i ascends within every group
        inner = np.argsort(joint, kind="stable")
        i, joint = i[inner], joint[inner]
        order[active] = i
        new = np.concatenate(([True], joint[1:] != joint[:-1]))
        head = np.maximum.accumulate(np.where(new, active, 0))
        rank[i] = head + 1
        alone = new & np.concatenate((new[1:], [True]))
        active = active[~alone]
        depth *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, run: np.ndarray, limit: int, lane: int = 512) -> np.ndarray:
    """For each entry of `order`, bytes shared with the entry before it, at most `limit` (Kasai's walk).

    order: places that all have `limit` bytes before their end; run[i]: how many such
    places follow i without a gap, itself included.  Stretches of `lane` consecutive
    places are walked side by side.
    """
    n = len(order)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    row = np.full(len(data) + 1, -1)
    row[order] = np.arange(n)
    there = np.sort(order)
    gap = np.concatenate(([True], there[1:] != there[:-1] + 1))
    first = np.flatnonzero(gap)
    length = np.diff(np.append(first, n))
    count = -(-length // lane)
    start = there[np.repeat(first, count)] + lane * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    left = np.minimum(lane, run[start])
    h = np.zeros(len(start), np.int64)
    at = start.copy()
    words = np.zeros(len(data) + 8, np.uint8)
    words[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(words, (len(data) + 1, 8), (1, 1))
    live = np.arange(len(start))
    while len(live):
        i = at[live]
        k = row[i]
        mate = np.where(k > 0, order[k - 1], -1)
        grow = np.flatnonzero(mate >= 0)
        now = np.where(mate >= 0, h[live], 0)
        while len(grow):
            p, q, d = i[grow], mate[grow], now[grow]
            grow = grow[d < limit]
            p, q, d = i[grow], mate[grow], now[grow]
            if not len(grow):
                break
            equal = eight[p + d] == eight[q + d]
            step = np.where(equal.all(1), 8, equal.argmin(1))
            now[grow] = np.minimum(d + step, limit)
            grow = grow[step == 8]
        shared[k] = now
        # the mate's successor bounds the next value only if it is in the order too
        follows = (mate >= 0) & (row[np.maximum(mate, 0) + 1] >= 0)
        h[live] = np.where(follows, np.maximum(now - 1, 0), 0)
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    return shared


def repeated_strings(runs: list[bytes], times: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of `size` bytes in distinct runs: their places in all runs end to end, whether each repeats, the data, and one place of each distinct string.

    times: how often each run occurs.
    """
    length = np.array([len(r) for r in runs], np.int64)
    data = np.frombuffer(b"".join(runs), np.uint8)
    begin = np.cumsum(length) - length
    end = np.repeat(begin + length, length)
    order = suffix_array(data, end)
    room = end - np.arange(len(data)) - size + 1
    order = order[room[order] > 0]
    shared = common_prefixes(data, order, room, size) >= size
    twice = shared | np.concatenate((shared[1:], [False])) if len(order) else np.zeros(0, bool)
    of = np.repeat(np.arange(len(runs)), length)
    twice |= times[of[order]] > 1
    # a group of equal strings repeats as a whole
    head = np.flatnonzero(~shared)
    if len(order):
        any_twice = np.logical_or.reduceat(twice, head)
        twice = np.repeat(any_twice, np.diff(np.append(head, len(order))))
    found = np.zeros(len(data), bool)
    found[order[twice]] = True
    return order, found, data, order[head]


# ---------------------------------------------------------------- the operator

SHARDED = "shard long, part long, block long, runs binary, lengths binary, owner binary, place binary"
_SHARDED = pa.schema([("shard", pa.int64()), ("part", pa.int64()), *((k, pa.int64() if k == "block" else pa.binary()) for k in ("block", "runs", "lengths", "owner", "place"))])
FOUND = "block long, range long, starts binary, counts binary, one binary, two binary, source binary"
_FOUND = pa.schema([("block", pa.int64()), ("range", pa.int64()), *((k, pa.binary()) for k in ("starts", "counts", "one", "two", "source"))])


def _runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as (first, count) of consecutive ones."""
    head = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + 1))) if len(starts) else np.zeros(0, np.int64)
    return starts[head], np.diff(np.append(head, len(starts)))


def _string_keys(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    codes = tb.BYTE_CODES[data]
    return tb.hash_windows(codes, size)[at], tb.hash_windows(codes, size, 1)[at]


def remove_repeated_strings(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes (null unless with_text)."""
    if size < 2 * GRAM:
        raise ValueError(f"strings need at least {2 * GRAM} bytes")
    blocks = tb.blocks_of(docs, id_col, text_col)
    density = 2 / (size - GRAM + 2)

    def anchors(block: tb.Block):
        return np.unique(pieces(block.texts, size)[0], return_counts=True)

    repeated, n_buckets = tb.repeated_keys(blocks, anchors, 4 * density)
    n_shards = max(16, int(blocks.total * 2 / (2 * tb.MEGABYTE)) + 1)
    n_ranges = blocks.groups(blocks.total)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SHARDED.empty_table()
        block = tb.block_of(left)
        anchor, start, count = pieces(block.texts, size)
        often = tb.counts_in(anchor, right, n_buckets)
        some = np.flatnonzero(often >= 2)
        anchor, start, count, often = anchor[some], start[some], count[some], often[some]
        # an anchor with many occurrences is a shard of its own, in as many parts as it needs
        many = often > hot
        shard = np.where(many, (anchor >> np.uint64(2)).astype(np.int64) + n_shards, (anchor % np.uint64(n_shards)).astype(np.int64))
        part = np.where(many, block.number % (often // hot + 1), -1)
        names, number = np.unique(np.stack((shard, part)), axis=1, return_inverse=True)
        raw, rows = block.texts.data.tobytes(), []
        for k, at in tb.dealt(number.ravel()):
            own: dict[bytes, int] = {}
            owner = [own.setdefault(raw[a : a + n + size - 1], len(own)) for a, n in zip(start[at].tolist(), count[at].tolist())]
            packed = tb.packed(lengths=np.array([len(r) for r in own], np.uint32), owner=np.array(owner, np.uint32), place=start[at].astype(np.uint32))
            rows.append({"shard": int(names[0, k]), "part": int(names[1, k]), "block": block.number, "runs": b"".join(own), **packed})
        return pa.Table.from_pylist(rows, _SHARDED)

    def sort(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        owners, sources, places = [], [], []
        for s, (raw, lengths, owner, place) in enumerate(zip(table["runs"].to_pylist(), table["lengths"].to_pylist(), table["owner"].to_pylist(), table["place"].to_pylist())):
            ends = np.cumsum(np.frombuffer(lengths, np.uint32)).tolist()
            ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends], ends)], np.int64)
            owners.append(ids[np.frombuffer(owner, np.uint32)])
            places.append(np.frombuffer(place, np.uint32).astype(np.int64))
            sources.append(np.full(len(places[-1]), s))
        owner, source, place = np.concatenate(owners), np.concatenate(sources), np.concatenate(places)
        runs = list(known)
        order, found, data, one_each = repeated_strings(runs, np.bincount(owner, minlength=len(runs)), size)
        length = np.array([len(r) for r in runs], np.int64)
        begin = np.cumsum(length) - length
        low, n = _runs_of(np.flatnonzero(found))
        # places found, cut at the ends of runs by construction, go to all documents that hold the run
        of = np.searchsorted(begin, low, "right") - 1
        by_run = np.searchsorted(of, np.arange(len(runs) + 1))
        each = np.diff(by_run)[owner]
        at = tb.ranges(by_run[owner], each)
        starts, counts, where = low[at] - begin[of[at]] + np.repeat(place, each), n[at], np.repeat(source, each)
        numbers = table["block"].to_pylist()
        rows = [{"block": numbers[s], "range": -1} | tb.packed(starts=starts[k].astype(np.uint32), counts=counts[k].astype(np.uint32)) for s, k in tb.dealt(where)]
        if table["part"][0].as_py() >= 0:
            # the strings of this part of a hot anchor's shard, sorted by key; those not found yet with the place that holds them
            one, two = _string_keys(data, one_each, size)
            turn = np.lexsort((two, one))
            one, two, one_each = one[turn], two[turn], one_each[turn]
            run = np.searchsorted(begin, one_each, "right") - 1
            holder = np.zeros(len(runs), np.int64)
            holder[owner] = np.arange(len(owner))
            who = holder[run]
            cell = np.zeros(len(one), [("block", "<i8"), ("start", "<i8")])
            cell["block"] = np.where(found[one_each], -1, np.array(numbers, np.int64)[source[who]])
            cell["start"] = one_each - begin[run] + place[who]
            for r, k in tb.dealt((one >> np.uint64(32)).astype(np.int64) * n_ranges >> 32):
                rows.append({"block": -1, "range": r} | tb.packed(one=one[k], two=two[k], source=cell[k]))
        return pa.Table.from_pylist(rows, _FOUND)

    def merge(table: pa.Table) -> pa.Table:
        """Strings that two parts hold, by binary search of each part's keys in the keys of all."""
        parts = [(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), [("block", "<i8"), ("start", "<i8")])) for a, b, c in zip(table["one"], table["two"], table["source"])]
        one, two = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        turn = np.lexsort((two, one))
        one, two = one[turn], two[turn]
        rows = []
        for a, b, cell in parts:
            low = np.searchsorted(one, a, "left")
            n = np.searchsorted(one, a, "right") - low
            same = np.concatenate(([0], np.cumsum(two[tb.ranges(low, n)] == np.repeat(b, n))))
            ends = np.cumsum(n)
            times = same[ends] - same[ends - n]
            new = cell[(times > 1) & (cell["block"] >= 0)]
            for number, k in tb.dealt(new["block"]):
                starts, counts = _runs_of(np.sort(new["start"][k]))
                rows.append({"block": number, "range": -1} | tb.packed(starts=starts.astype(np.uint32), counts=counts.astype(np.uint32)))
        return pa.Table.from_pylist(rows, _FOUND)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCHEMA.empty_table()
        block = tb.block_of(left)
        texts = block.texts
        starts, counts = (tb.unpacked(right[k], np.uint32).astype(np.int64) for k in ("starts", "counts"))
        edge = np.zeros(len(texts.data) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + counts + size - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = texts.start[:-1][np.diff(texts.start) > 0]
        first[inner] = gone[inner]
        total = np.concatenate(([0], np.cumsum(gone)))[texts.start]
        spans = np.concatenate(([0], np.cumsum(first)))[texts.start]
        kept = [texts.data[a:b][~gone[a:b]].tobytes() for a, b in zip(texts.start[:-1], texts.start[1:])]
        shas = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.table([block.table["id"], pa.array(np.diff(texts.start)), pa.array(np.diff(total)), pa.array(np.diff(spans)), pa.array(shas, pa.string()), pa.array(kept if with_text else [None] * len(kept), pa.binary())], schema=_SCHEMA)

    by_block = blocks.docs.groupBy("block")
    sharded = by_block.cogroup(repeated.groupBy("block")).applyInArrow(send, SHARDED)
    found = tb.checkpointed(sharded.groupBy("shard", "part").applyInArrow(sort, FOUND))
    merged = found.where("range >= 0").groupBy("range").applyInArrow(merge, FOUND)
    covered = found.where("range < 0").unionByName(merged).select("block", "starts", "counts")
    return by_block.cogroup(covered.groupBy("block")).applyInArrow(finish, RESULT)
