"""Source divergence audit: how far each source of a language is from the others, and by which terms.

A term is a maximal run of ASCII letters and of characters beyond ASCII, A-Z lower-cased.
Each language keeps the terms in at least `min_docs` of its documents.  A group (language,
source), and the language as a whole, give each kept term a smoothed share

    p = 1 + floor(10^9 * (count + 2) / (N + 2 V))

and two of them differ at a term by floor((p - q)^2 / (p + q)), all in whole numbers.

Term-block dense matrices: a language's kept terms are dealt into blocks by a hash, so that
neither a large language nor a large source makes a large task.  A block becomes one dense
tile, groups by terms; numpy subtracts all pairs of its rows by broadcasting.  Partial sums
of pairs are added up by Spark, and each tile's heaps of the best `most` terms of a group
are merged by their rank.  A term's row has one entry a source at most; the result has a row
for each pair of sources, so what a task holds of a language's sources is never more than
the square root of what is asked for.

Null language, source and text are ''.  A group without terms has N = 0; a language without
kept terms gives each pair 0.  Repeated rows are counted each.  Ties are ranked by the bytes
of the item.  Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb

SCALE = 10**9
TERMS = 4096  # of a tile, more where a language has so many sources that pairs would outnumber cells
CELLS = 1 << 23  # of a tile at most
STRIP = 1 << 21  # differences held at a time
RESULT = "lang string, source string, part string, item string, value long"
_COUNTS = "lang string, source string, term string, n long, docs long"
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of terms: ASCII letters, and all bytes of other characters."""
    return ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | (data >= 128)


def term_codes(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Document and code of each term in order, and the terms by code."""
    data = tb.lower_ascii(texts.data)
    inside = letters(data)
    words = tb.split_words(tb.Texts(data, texts.start), ~inside)
    offsets = np.concatenate(([0], np.cumsum(words.end - words.begin))).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(words.begin), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.diff(words.first)), terms.indices.to_numpy().astype(np.int64), terms.dictionary


def group_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch[c].dictionary_encode() for c in ("lang", "source")]
            both = names[0].indices.to_numpy().astype(np.int64) * max(1, len(names[1].dictionary)) + names[1].indices.to_numpy()
            for a, b, texts in tb.texts_of(batch["text"]).chunks(4 * tb.MEGABYTE):
                doc, code, terms = term_codes(texts)
                width = max(1, len(terms))
                pair, times = np.unique(doc * width + code, return_counts=True)
                cell, at = np.unique(both[a:b][pair // width] * width + pair % width, return_inverse=True)
                group, term = cell // width, cell % width
                lang, source = np.divmod(group, max(1, len(names[1].dictionary)))
                yield pa.RecordBatch.from_arrays(
                    [names[0].dictionary.take(pa.array(lang)), names[1].dictionary.take(pa.array(source)), terms.take(pa.array(term)), pa.array(np.bincount(at, times, len(cell)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(cell)))],
                    schema=_SCHEMA,
                )

    return _named(docs, lang_col, source_col, text_col).mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame, lang_col: str, source_col: str, *more: str) -> DataFrame:
    filled = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    return docs.select(filled(lang_col, "lang"), filled(source_col, "source"), *[filled(c, "text") for c in more])


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), three digits at a time: exact up to 9 * 10^15 occurrences."""
    rest, whole = np.asarray(count) + 2, np.asarray(total) + 2 * kept
    out = np.zeros_like(rest)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(p: np.ndarray) -> np.ndarray:
    """Sums over all terms of the difference of each pair of rows, above the diagonal."""
    n, width = p.shape
    out = np.zeros((n, n), np.int64)
    step = max(1, STRIP // max(1, n * width))
    for a in range(0, n, step):
        out[a : a + step, a:] = difference(p[a : a + step, None, :], p[None, a:, :]).sum(2)
    return np.triu(out, 1)


def audit(docs: DataFrame, min_docs: int = 10, most: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank).

    part `pair`: all other sources of the language by falling difference over all kept
    terms; part `term`: the `most` kept terms that the group uses more than its language
    does and that differ most.
    """
    cells = group_counts(docs, lang_col, source_col, text_col).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = tb.checkpointed(cells.where(F.col("docs") >= min_docs).select("lang", "term", "cells"))
    used = kept.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("total"))
    groups = _named(docs, lang_col, source_col).distinct().join(used, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("group"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list("group")).alias("groups"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    terms = F.least(F.greatest(F.lit(TERMS), 8 * F.size("groups")), F.greatest(F.lit(1), F.lit(CELLS) / F.size("groups")))
    langs = tb.checkpointed(langs.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("long")))
    dealt = kept.join(langs.select("lang", "n_blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("n_blocks")).alias("block"), "term", "cells").toDF("lang", "block", "term", "cells")
    rows = langs.select("lang", "groups", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")).toDF("lang", "groups", "v", "block")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, v = right["lang"][0].as_py(), right["v"][0].as_py()
        group = right["groups"].combine_chunks().flatten()
        sources, total = group.field("source"), group.field("total").to_numpy()
        left = left.take(pc.sort_indices(left["term"])) if left.num_rows else left
        terms = left["term"].combine_chunks()
        lists = left["cells"].combine_chunks()
        count = np.zeros((len(sources), len(terms)), np.int64)
        if len(terms):
            flat = lists.flatten()
            count[pc.index_in(flat.field("source"), value_set=sources).to_numpy(), pc.list_parent_indices(lists).to_numpy()] = flat.field("n").to_numpy()
        p, q = shares(count, total[:, None], v), shares(count.sum(0), total.sum(), v)
        a, b = np.triu_indices(len(sources), 1)
        out = [(sources.take(pa.array(a)), "pair", sources.take(pa.array(b)), pair_sums(p)[a, b])]
        for g in range(len(sources)):
            f = np.where((count[g] > 0) & (p[g] > q), difference(p[g], q), -1)
            best = heapq.nsmallest(most, zip((-f[f >= 0]).tolist(), np.flatnonzero(f >= 0).tolist()))  # terms are in order
            at = np.array([t for _, t in best], np.int64)
            out.append((sources.take(pa.array(np.full(len(at), g))), "term", terms.take(pa.array(at)), f[at]))
        tables = [pa.table({"lang": pa.array([lang] * len(item), pa.string()), "source": source, "part": pa.array([part] * len(item), pa.string()), "item": item, "value": pa.array(value, pa.int64())}) for source, part, item, value in out]
        return pa.concat_tables(tables)

    parts = dealt.groupBy("lang", "block").cogroup(rows.groupBy("lang", "block")).applyInArrow(tile, RESULT)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    both = summed.select("lang", "part", "value", F.explode(ways).alias("way")).select("lang", "way.source", "part", "way.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= most))
