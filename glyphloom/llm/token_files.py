"""Token-id files of bit planes.

A file holds blocks of at most `block_ids` ids.  A block's ids, unsigned 32-bit, are
transposed: bit plane k holds bit k of every id, eight ids to a byte ("bit"), or byte plane
k holds byte k of every id ("byte").  Each plane is compressed with zstandard by itself;
planes of zeros only, as the high ones are, take no bytes.  After the blocks comes the
index: for each block its place, its number of ids and its planes' lengths, then each
document's id and number of ids, and a footer with the index's place.

    b"BPL1" | planes of block 0, 1, ... | index (zstandard, little-endian) | index offset u64 | index length u64 | b"BPL1"

write_token_files deals documents by ranges of doc_id and, within a file, sorts them by
doc_id and text hash, so files in the order of their numbers hold all ids in ascending
order of doc_id, null first.  A task writes under a name of its own and renames it at the
end, so a repeated task replaces a file by its equal.  Files go to a folder that all
executors reach, through pyarrow's file systems, so its scheme may be any that these know.

Null and empty texts have no ids besides the end id.  Rows with equal doc_id follow each
other in the order of their texts' hashes; null ids come back as null.  Other columns are
not read.  An empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe
from . import textblocks as tb

MAGIC = b"BPL1"
BLOCK_IDS = 1 << 16
GROUP = 1000  # chunks that the library encodes as one text
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
FILES = "number int, path string, n_docs long, n_ids long"


# ---------------------------------------------------------------- the format


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; b"" for a plane of zeros only."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [raw[:, k] for k in range(4)]
    else:
        planes = []
        for k in range(4):
            column = np.ascontiguousarray(raw[:, k])
            bits = np.unpackbits(column, bitorder="little").reshape(-1, 8) if column.any() else np.zeros((0, 8), np.uint8)
            planes += [np.packbits(bits[:, b], bitorder="little") for b in range(8)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k in range(4):
        if kind == "byte":
            if planes[k]:
                raw[:, k] = np.frombuffer(planes[k], np.uint8)
        elif any(planes[8 * k : 8 * k + 8]):
            bits = np.zeros((n, 8), np.uint8)
            for b, p in enumerate(planes[8 * k : 8 * k + 8]):
                if p:
                    bits[:, b] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
            raw[:, k] = np.packbits(bits, bitorder="little")
    return raw.reshape(-1).view("<u4")


class Writer:
    """Writes one file; holds one block of ids at a time."""

    def __init__(self, out, kind: str = "bit", block_ids: int = BLOCK_IDS, level: int = 3):
        if kind not in ("bit", "byte"):
            raise ValueError(f"planes are of bits or bytes, not {kind}")
        self.out, self.kind, self.block_ids, self.squeeze = out, kind, block_ids, zstandard.ZstdCompressor(level).compress
        self.place, self.blocks, self.docs, self.waiting, self.n_waiting = len(MAGIC), [], [], [], 0
        out.write(MAGIC)

    def add(self, docs: np.ndarray, ids: np.ndarray) -> None:
        """Some documents (DOC) and their ids, end to end."""
        self.docs.append(docs)
        self.waiting.append(ids.astype("<u4"))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            whole = np.concatenate(self.waiting)
            cut = len(whole) // self.block_ids * self.block_ids
            for low in range(0, cut, self.block_ids):
                self._block(whole[low : low + self.block_ids])
            self.waiting, self.n_waiting = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.squeeze(p) if p else b"" for p in to_planes(ids, self.kind)]
        self.blocks.append([self.place, len(ids), *map(len, planes)])
        self.out.write(b"".join(planes))
        self.place += sum(map(len, planes))

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, DOC)
        head = json.dumps({"kind": self.kind, "blocks": len(self.blocks), "docs": len(docs)}).encode()
        index = self.squeeze(len(head).to_bytes(4, "little") + head + np.array(self.blocks, "<i8").tobytes() + docs.tobytes())
        self.out.write(index + self.place.to_bytes(8, "little") + len(index).to_bytes(8, "little") + MAGIC)
        return len(docs), sum(b[1] for b in self.blocks)


class Reader:
    """Reads one file block by block."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._at(size - 20, 20)
        if tail[16:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a whole file of bit planes")
        place, length = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        self.expand = zstandard.ZstdDecompressor().decompress
        raw = self.expand(self._at(place, length))
        n = int.from_bytes(raw[:4], "little")
        head = json.loads(raw[4 : 4 + n])
        self.kind = head["kind"]
        width = 2 + (4 if self.kind == "byte" else 32)
        self.blocks = np.frombuffer(raw, "<i8", head["blocks"] * width, 4 + n).reshape(-1, width)
        self.docs = np.frombuffer(raw, DOC, head["docs"], 4 + n + 8 * self.blocks.size)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        place, n, *lengths = self.blocks[k].tolist()
        raw, planes = self._at(place, sum(lengths)), []
        for length in lengths:
            planes.append(self.expand(raw[:length]) if length else b"")
            raw = raw[length:]
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the file's order."""
        held, k = np.zeros(0, "<u4"), 0
        for i, null, n in self.docs.tolist():
            parts = [held]
            while sum(map(len, parts)) < n:
                parts.append(self.block(k))
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else i, held[:n]
            held = held[n:]


# ---------------------------------------------------------------- encoding


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class _Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, which makes a scalar for each cell first."""
    return column.to_numpy(zero_copy_only=False).tolist()


class LibraryEncoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Plain byte-level BPE (no normalizer, the standard split) never joins what two single
    spaces or line ends part: such a mark and the chunk after it are encoded alike wherever
    they stand.  Arrow cuts the texts of a call and finds their distinct chunks; the library encodes
    each once as long as it is remembered, many in one text; tokens' lengths tell where each ends.  Of too many
    remembered chunks the half met most often stays.  Texts in which white space meets white space
    are cut by the split's pattern instead, and the library encodes each distinct piece.  A
    text with a special token's string in it, and any other tokenizer's texts, it encodes whole.
    """

    def __init__(self, path: str, cached: int = 600_000):
        self.tokenizer, self.cached = _tokenizer(path), cached
        how = json.loads(self.tokenizer.to_str())
        split, model = how["pre_tokenizer"] or {}, how["model"]
        self.plain = not how["normalizer"] and not model.get("dropout") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex")
        self.special = [t["content"] for t in how["added_tokens"]]
        self.pieces = bpe.Encoder(self._merge, BYTE_LEVEL_SPLIT)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # a byte-level token has a character for each byte
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.chunks, self.ids, self.place, self.met = _Numbers(), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the half that was met most often; what it was met counts half from now on."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[: self.cached // 2])
        names = list(self.chunks)
        self.chunks = _Numbers((names[k], i) for i, k in enumerate(stay.tolist()))
        n = self.place[stay + 1] - self.place[stay]
        self.ids, self.place = self.ids[tb.ranges(self.place[stay], n)], np.concatenate(([0], np.cumsum(n)))
        self.met = self.met[stay] // 2

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(made) if made else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum([len(ids) for ids in made]))).astype(np.int64)

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._whole([p.decode() for p in pieces])

    def _learn(self, chunks: pa.Array) -> None:
        """Encode the chunks that were met for the first time, in the order of their numbers."""
        if not len(chunks):
            return
        led = pc.if_else(pc.starts_with(chunks, "\n"), chunks, pc.binary_join_element_wise(pa.scalar(" ", chunks.type), chunks, pa.scalar("", chunks.type)))
        led = tb.texts_of(led)
        cuts = led.start[[*range(0, len(led), GROUP), len(led)]].tolist()
        ids, _ = self._whole([led.data[a:b].tobytes().decode() for a, b in pairwise(cuts)])
        place = np.searchsorted(np.cumsum(self.n_bytes[ids]), led.start[1:]) + 1
        self.place = np.concatenate((self.place, place + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))
        self.met = np.concatenate((self.met, np.zeros(len(led), np.int64)))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and n + 1 places; null is an empty text."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).cast(pa.large_string()).fill_null("")
        if not self.plain or not len(texts):
            return self._whole(_strings(texts))
        if len(self.chunks) > self.cached:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded, count = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        entry, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), count)
        leads = np.zeros(len(entry), bool)  # a text's first chunk has no mark before it
        leads[np.cumsum(count) - count] = True
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        marked = ~leads & ~whole[text]
        times = np.bincount(entry[marked], minlength=len(coded.dictionary))
        # a chunk comes after a space, or after a line end, with which it then starts; one whose ends touch other white space gets no number
        inner = pc.ascii_ltrim(coded.dictionary, "\n")
        length = pc.binary_length(inner).to_numpy()
        fit = np.flatnonzero((times > 0) & (length > 0) & (pc.binary_length(pc.utf8_trim_whitespace(inner)).to_numpy() == length))
        names, done = coded.dictionary.take(pa.array(fit)), len(self.chunks)
        numbers = np.fromiter(map(self.chunks.__getitem__, _strings(names)), np.int64, len(fit))
        self._learn(names.filter(pa.array(numbers >= done)))
        self.met[numbers] += times[fit]
        number = np.full(len(times), -1)
        number[fit] = numbers
        number = number[entry]
        firsts = coded.dictionary.take(pa.array(entry[leads]))
        cut = pc.binary_length(pc.utf8_rtrim_whitespace(firsts)).to_numpy() < pc.binary_length(firsts).to_numpy()
        cut[text[marked & (number < 0)]] = True
        cut &= ~whole
        plain = ~whole & ~cut
        # the first chunk's place stands for the whole text where that is not put together from chunks
        pool, size, begin, n = [self.ids], len(self.ids), self.place[number], self.place[number + 1] - self.place[number]
        head = np.flatnonzero(leads)
        for which, encode, given in ((whole, self._whole, texts), (cut, self.pieces.encode, texts), (plain, self._whole, firsts)):
            ids, place = encode(_strings(given.filter(pa.array(which))))
            begin[head[which]], n[head[which]] = size + place[:-1], np.diff(place)
            pool.append(ids)
            size += len(ids)
        kept = leads | plain[text]
        begin, n, head = begin[kept], n[kept], np.flatnonzero(leads[kept])
        return np.concatenate(pool)[tb.ranges(begin, n)], np.concatenate(([0], np.cumsum(np.add.reduceat(n, head))))


@lru_cache(1)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each worker process, so that its tasks share what was encoded."""
    return LibraryEncoder(path)


#: Fixed value: the split of byte-level BPE.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ---------------------------------------------------------------- the operator


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, kind: str = "bit", block_ids: int = BLOCK_IDS, n_files: int | None = None) -> list:
    """Write the files into `folder` and return their rows (FILES), one a file, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, target, number = None, None, TaskContext.get().partitionId()
        for batch in batches:
            for a, b, _ in tb.texts_of(batch["text"]).chunks(4 * tb.MEGABYTE):
                part = batch.slice(a, b - a)
                if target is None:
                    encoder = library_encoder(tokenizer)
                    system, top = pyarrow.fs.FileSystem.from_uri(folder)
                    name = f"{top}/part-{number:06d}.bpl"
                    own = f"{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(own)
                    target = Writer(out, kind, block_ids)
                ids, place = encoder.encode(part["text"])
                ended = np.insert(ids, place[1:], end_id)
                cells = np.zeros(b - a, DOC)
                cells["id"], cells["null"], cells["n"] = part["doc_id"].fill_null(0).to_numpy(), part["doc_id"].is_null().to_numpy(zero_copy_only=False), np.diff(place) + 1
                target.add(cells, ended)
        if target is not None:
            n_docs, n_ids = target.close()
            out.close()
            system.move(own, name)
            yield pa.RecordBatch.from_pylist([{"number": number, "path": name, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    system, top = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(top)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ranged = chosen.repartitionByRange(n_files, *by) if n_files else chosen.repartitionByRange(*by)
    return sorted(ranged.sortWithinPartitions(*by).drop("h").mapInArrow(run, FILES).collect(), key=lambda r: r.number)


def read_token_files(spark: SparkSession, files: list, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone; files in their order.

    Where a file's ids start is added up from the indexes of the files before it, one number a file.
    """
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for path in batch["path"].to_pylist():
                with pyarrow.fs.FileSystem.from_uri(folder)[0].open_input_file(path) as file:
                    held.append(int(Reader(file).docs["n"].sum()))
            yield pa.RecordBatch.from_arrays([batch["place"], pa.array(held, pa.int64())], ["place", "ids"])

    paths = spark.createDataFrame([(k, f.path) for k, f in enumerate(files)], "place long, path string").repartition(min(len(files), 1000))
    ids = dict(paths.mapInArrow(sizes, "place long, ids long").collect())
    start, rows = 0, []
    for k, f in enumerate(files):
        rows.append((f.path, start))
        start += ids[k]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                with pyarrow.fs.FileSystem.from_uri(folder)[0].open_input_file(path) as file:
                    made = []
                    for i, ids in Reader(file).documents():
                        made.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(made) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=schema)
                            made = []
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=schema)

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **how) -> DataFrame:
    """Write the files, into a new folder below the shared one unless one is named, and read them back."""
    folder = folder or f"{tb.shared_folder(docs)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, folder, **how), folder)
