"""Removal of repeated word sequences, found through difference-cover anchors.

A window is `window` consecutive words of one document.  Each word covered by a window
whose word sequence also starts earlier goes.  The cover {0, 1, 3, 9} modulo 13 has every
difference modulo 13, so two equal windows at any two positions share an offset below 13
at which both positions lie in the cover; hashes of window - 12 words at cover positions
alone therefore show every repeat.  Windows around anchors that occur twice are then
extended: whole windows are compared by a 128-bit hash and the earliest one is found.

Order of documents: id (null first), then the text's hash.  Rows equal in id and text
count as one document listed more than once: none is earlier than the other, and each
gets the same result.  Null and empty texts have no words.  The input's other columns
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb

PERIOD = 13
COVER = (0, 1, 3, 9)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _anchors(words: tb.Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts at cover positions, counted from each text's first word, and their hashes."""
    starts = tb.inside_texts(words.first, size)
    offset = starts - np.repeat(words.first[:-1], np.maximum(np.diff(words.first) - size + 1, 0))
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    starts = starts[in_cover[offset % PERIOD]]
    return starts, tb.hash_windows(hashes, size)[starts] if len(starts) else np.zeros(0, np.uint64)


def _first_of_each(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each 128-bit key the place of its first occurrence."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    head = np.flatnonzero(np.concatenate(([True], ~same))) if len(one) else np.zeros(0, np.int64)
    first = np.empty(len(one), np.int64)
    first[order] = np.repeat(order[head], np.diff(np.append(head, len(one))))
    return first


def _candidates(block: tb.Block, repeated: pa.Table, n_buckets: int, window: int):
    """Windows near a repeated anchor: document, first word, two hashes, and the first equal one in this block."""
    size = window - PERIOD + 1
    parts, n_words = [], np.zeros(len(block.texts), np.int64)
    for a, b, texts in block.texts.chunks():
        words = tb.split_words(texts)
        n_words[a:b] = np.diff(words.first)
        if not repeated.num_rows:
            continue
        hashes = tb.hash_words(texts.data, words)
        starts, keys = _anchors(words, hashes, size)
        starts = starts[tb.counts_in(keys, repeated, n_buckets) >= 2]
        near = np.zeros(len(hashes) + 1, np.int64)
        near[starts + 1] = 1
        near = np.cumsum(near)
        at = tb.inside_texts(words.first, window)
        at = at[near[at + PERIOD] > near[at]]
        if len(at):
            doc = np.searchsorted(words.first, at, "right") - 1
            parts.append((doc + a, at - words.first[doc], tb.hash_windows(hashes, window)[at], tb.hash_windows(hashes, window, 1)[at]))
    doc, word, one, two = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    first = _first_of_each(one, two)
    return n_words, doc, word, one, two, first


def _is_other(block: tb.Block, doc: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a window differs from its first equal one in place, and not only in the listing of its row."""
    d, e = doc, doc[first]
    return (word != word[first]) | (block.ids[d] != block.ids[e]) | (block.hashes[d] != block.hashes[e])


def _late_windows(table: pa.Table) -> pa.Table:
    """Windows of a bucket that start earlier elsewhere, one row for each row received.

    Time grows with the windows, not with windows times senders: a bucket hears from every block.
    """
    kinds = {"one": np.uint64, "two": np.uint64, "id": np.int64, "h": np.int64, "word": np.uint32, "seq": np.uint32}
    x = {k: tb.unpacked(table[k], t) for k, t in kinds.items()}
    source = np.repeat(np.arange(table.num_rows), tb.lengths(table["seq"], np.uint32))
    order = np.lexsort((x["word"], x["h"], x["id"], x["two"], x["one"]))
    x, source = {k: v[order] for k, v in x.items()}, source[order]
    same = lambda *ks: np.logical_and.reduce([x[k][1:] == x[k][:-1] for k in ks])
    head = np.concatenate(([True], ~same("one", "two"))) if len(source) else np.zeros(0, bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = (x["id"] != x["id"][first]) | (x["h"] != x["h"][first]) | (x["word"] != x["word"][first])
    numbers, seq = table["block"].to_pylist(), x["seq"][late]
    rows = [{"block": numbers[s], "seq": seq[at].tobytes()} for s, at in tb.dealt(source[late])]
    return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("seq", pa.binary())]))


def remove_repeated_sequences(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and the kept words joined by spaces (null unless with_text)."""
    if window < PERIOD + 1:
        raise ValueError(f"a window needs more than {PERIOD} words")
    blocks = tb.blocks_of(docs, id_col, text_col)
    size = window - PERIOD + 1

    def anchor_keys(block: tb.Block):
        found = []
        for _, _, texts in block.texts.chunks():
            words = tb.split_words(texts)
            found.append(_anchors(words, tb.hash_words(texts.data, words), size)[1])
        return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)

    repeated, n_buckets = tb.repeated_keys(blocks, anchor_keys, 8 * len(COVER) / PERIOD / 6)
    n_groups = blocks.groups(blocks.total)
    sent_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in ("one", "two", "id", "h", "word", "seq"))])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sent_schema.empty_table()
        block = tb.block_of(left)
        _, doc, word, one, two, first = _candidates(block, right, n_buckets, window)
        own = np.flatnonzero(first == np.arange(len(first)))
        rows = []
        for b, at in tb.dealt((one[own] % np.uint64(n_groups)).astype(np.int64)):
            w = own[at]
            rows.append({"bucket": b, "block": block.number} | tb.packed(one=one[w], two=two[w], id=block.ids[doc[w]], h=block.hashes[doc[w]], word=word[w].astype(np.uint32), seq=w.astype(np.uint32)))
        return pa.Table.from_pylist(rows, sent_schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """`right` holds this block's repeated anchors and, as seq, its windows that start earlier in other blocks."""
        block = tb.block_of(left)
        late_rows = right.filter(pa.compute.is_valid(right["seq"]))
        known = right.filter(pa.compute.is_valid(right["keys"]))
        n_words, doc, word, one, two, first = _candidates(block, known, n_buckets, window)
        late = np.zeros(len(first), bool)
        late[tb.unpacked(late_rows["seq"], np.uint32)] = True
        gone = late[first] | _is_other(block, doc, word, first)
        begin = np.concatenate(([0], np.cumsum(n_words)))
        covered = tb.spread((begin[doc] + word)[gone], window, int(begin[-1]))
        out = {"doc_id": block.table["id"], "n_words": n_words, "n_removed": [], "kept_sha256": [], "kept": []}
        for i in range(len(block.texts)):
            words = block.texts.bytes(i).split()  # the same white space as [\x20\x09-\x0D]
            goes = covered[begin[i] : begin[i + 1]]
            kept = b" ".join(compress(words, (~goes).tolist()) if goes.any() else words)
            out["n_removed"].append(int(goes.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode() if with_text else None)
        return pa.table(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))

    by_block = blocks.docs.groupBy("block")
    windows = by_block.cogroup(repeated.groupBy("block")).applyInArrow(send, "bucket long, block long, one binary, two binary, id binary, h binary, word binary, seq binary")
    late = windows.groupBy("bucket").applyInArrow(_late_windows, "block long, seq binary")
    known = repeated.unionByName(late, allowMissingColumns=True)
    return by_block.cogroup(known.groupBy("block")).applyInArrow(lambda left, right: finish(left, right) if left.num_rows else pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()))}), RESULT)
