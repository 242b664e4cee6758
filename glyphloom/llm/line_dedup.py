"""Line dedup by frequency on a site: lines on too large a share of a host's pages go.

For each host, the pages that hold a line are counted once each and divided by the host's
pages.  A line with a word in it is boilerplate if it is on more than `percent` of them and
repeats: on `min_pages` pages or more, or, where the host is too small for that to say much,
on at least two pages and more than half of all.  All occurrences of it on that host's pages
go.  Lines are split at \\n and compared exactly, by a 64-bit hash within a host.

Blocks count their own lines first, so a line that a third of all pages share reaches the
counting as one row a block.  These rows keep their block's number through the counting, so
a boilerplate line goes back to the blocks that have it and to no others.

A page with null host belongs to no site and stays as it is.  Null and empty texts have no
lines and stay.  Lines without a word are neither counted nor dropped.  Repeated rows are
pages of their own.  Other columns are carried along; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

NEWLINE = 10


def _lines(texts: tb.Texts) -> tuple[tb.Words, np.ndarray]:
    """Lines with a word in them, and their hashes."""
    lines = tb.split_words(texts, texts.data == NEWLINE)
    if not len(lines.begin):
        return lines, np.zeros(0, np.uint64)
    letters = np.concatenate(([0], np.cumsum(~tb.space_mask(texts.data))))
    filled = letters[lines.end] > letters[lines.begin]
    first = np.concatenate(([0], np.cumsum(filled)))[lines.first]
    lines = tb.Words(lines.begin[filled], lines.end[filled], first)
    return lines, tb.hash_words(texts.data, lines)


def _hosts(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number for each row's host, and the hosts."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _boilerplate(blocks: tb.Blocks, percent: float, min_pages: int) -> DataFrame:
    """(block, host, line) for each boilerplate line and each block that has it."""
    schema = pa.schema([("block", pa.int64()), ("host", pa.string()), ("line", pa.int64()), ("pages", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        block = tb.block_of(table)
        host, names = _hosts(block.table["host"])
        keys, hosts = [], []
        for a, b, texts in block.texts.chunks():
            lines, hashes = _lines(texts)
            doc = np.repeat(np.arange(a, b), np.diff(lines.first))
            own = np.unique(np.stack((doc.astype(np.uint64), hashes)), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
            keys.append(own[1])
            hosts.append(host[own[0].astype(np.int64)])
        key, of = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(hosts or [np.zeros(0, np.int64)])
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(key)))
        made = pa.table([pa.array(np.full(len(head), block.number)), pa.array([names[x] for x in of[head]], pa.string()), pa.array(key[head].view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)
        return made.filter(pa.compute.is_valid(made["host"]))

    pages = blocks.docs.where("host is not null")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counted = blocks.docs.groupBy("block").applyInArrow(count, "block long, host string, line long, pages long")
    often = counted.withColumn("all_pages", F.sum("pages").over(Window.partitionBy("host", "line"))).where(F.col("all_pages") >= 2)
    repeats = (F.col("all_pages") >= min_pages) | (F.col("all_pages") * 2 > F.col("total"))
    return often.join(totals, "host").where(repeats & (F.col("all_pages") * 100 > F.lit(percent) * F.col("total"))).select("block", "host", "line")


def _dropped(block: tb.Block, flagged: pa.Table):
    """For each text: its kept bytes, lines with a word, and how many of them go."""
    host, names = _hosts(block.table["host"])
    number = {x: k for k, x in enumerate(names)}
    salt = tb.STEPS[7]
    joint = lambda key, of: tb.mix(key + of.astype(np.uint64) * salt)
    gone_keys = np.sort(joint(flagged["line"].combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64), np.array([number.get(x, -1) for x in flagged["host"].to_pylist()], np.int64))) if flagged.num_rows else np.zeros(0, np.uint64)
    for a, b, texts in block.texts.chunks():
        lines, hashes = _lines(texts)
        doc = np.repeat(np.arange(b - a), np.diff(lines.first))
        gone = tb.member(joint(hashes, host[a:b][doc]), gone_keys) >= 0
        n = np.diff(lines.first)
        removed = np.bincount(doc[gone], minlength=b - a)
        for i in range(b - a):
            raw = texts.bytes(i)
            if removed[i]:
                here = slice(lines.first[i], lines.first[i + 1])
                starts = set((lines.begin[here][gone[here]] - texts.start[i]).tolist())
                kept, at = [], 0
                for line in raw.split(b"\n"):
                    if at not in starts:
                        kept.append(line)
                    at += len(line) + 1
                raw = b"\n".join(kept)
            yield raw, int(n[i]), int(removed[i])


def _by_block(docs: DataFrame, host_col: str, text_col: str, percent: float, min_pages: int, extra: dict, finish, schema: T.StructType) -> DataFrame:
    blocks = tb.blocks_of(docs, "doc_id", text_col, {"host": F.col(f"`{host_col}`").cast("string"), **extra})
    flagged = _boilerplate(blocks, percent, min_pages)
    kind = T.StructType(schema.fields)
    return blocks.docs.groupBy("block").cogroup(flagged.groupBy("block")).applyInArrow(finish, kind)


def line_digests(docs: DataFrame, host_col: str = "source", text_col: str = "text", percent: float = 5, min_pages: int = 5) -> DataFrame:
    """doc_id, n_lines with a word, n_removed, and the hash of the remaining lines joined by \\n."""
    names = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema(zip(names, kinds)).empty_table()
        block = tb.block_of(left)
        made = [(hashlib.sha256(raw).hexdigest(), n, k) for raw, n, k in _dropped(block, right)]
        return pa.table([block.table["id"], pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64()), pa.array([x[0] for x in made], pa.string())], names)

    schema = T.StructType([T.StructField(n, T.StringType() if n == "kept_sha256" else T.LongType()) for n in names])
    return _by_block(docs, host_col, text_col, percent, min_pages, {}, finish, schema)


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", percent: float = 5, min_pages: int = 5, length_col: str | None = None) -> DataFrame:
    """docs with shortened texts and all other columns as they were; length_col, if named, gets the new length in characters."""

    rows = tb.WholeRows(docs, text_col)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows.empty()
        block = tb.block_of(left)
        made = list(_dropped(block, right))
        texts = [raw.decode() for raw, _, _ in made]
        own = rows.columns_of(block.table, texts)
        if length_col:
            own[length_col] = pa.array([len(t) if k else n for t, (_, _, k), n in zip(texts, made, own[length_col].to_pylist())], own[length_col].type)
        return pa.table(own)

    return _by_block(docs, host_col, text_col, percent, min_pages, {"row": rows.struct()}, finish, docs.schema)
