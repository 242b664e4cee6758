import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import samples
from tokenizers import Tokenizer

from glyphloom.llm import token_files as F

FILE = P.path("byte_bpe_50k.json")


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_format_round_trip(kind):
    rng, out = np.random.default_rng(1), Buffer()
    docs = [rng.integers(0, top, n).astype("<u4") for top, n in [(50_000, 7), (2**32, 9), (2, 0), (5, 1000), (70_000, 33), (1, 64)]]
    w = F.Writer(out, kind, block_ids=50)
    cells = np.zeros(len(docs), F.DOC)
    cells["id"], cells["n"], cells["null"] = range(len(docs)), [len(d) for d in docs], [1, 0, 0, 0, 0, 0]
    w.add(cells[:2], np.concatenate(docs[:2]))
    w.add(cells[2:], np.concatenate(docs[2:]))
    assert w.close() == (6, sum(map(len, docs)))
    back = list(F.Reader(out).documents())
    assert [i for i, _ in back] == [None, 1, 2, 3, 4, 5] and all((a == b).all() for (_, a), b in zip(back, docs))
    with pytest.raises(ValueError):
        F.Reader(Buffer(out.getvalue()[:-1]))
    with pytest.raises(ValueError):
        F.Writer(Buffer(), "nibble")


def test_as_the_library(spark, tmp_path):
    odd = ["a<|endoftext|>b", "it's  \n\n x", "日本語👩‍👩‍👧", "x" * 3000, "\x1c\x85 　z", " lead", "trail ", "two  spaces", "line \n end", "a\n b", "\nstart here", "é ß\tü x", ""]
    rows = samples.rows(3) + [(2000 + k, t) for k, t in enumerate(odd)] + [(None, "null id"), (7, "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int").repartition(3)
    t = Tokenizer.from_file(FILE)
    got = F.round_trip(df, FILE, n_files=4, block_ids=100).collect()
    want, start = {}, 0
    ids = {(i, x or ""): [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), crc(x)) for (i, _), x in ids.items())
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order) and order[0] == -1
    assert F.round_trip(df.limit(0), FILE).count() == 0
    named = F.round_trip(df, FILE, folder=str(tmp_path / "here"), kind="byte")
    assert named.count() == len(rows) and list((tmp_path / "here").glob("*.bpl"))


def test_chunks_are_encoded_alike_everywhere():
    import random

    rnd, t = random.Random(4), Tokenizer.from_file(FILE)
    parts = ["a", "The", "don't", "x.\ny", "\n", "\t", "", "é", "12", "3,4", "!?", "<|endoftext|>", "日本", "\u00a0", "\x1f", "I'll", "'s"]
    e = F.LibraryEncoder(FILE, cached=20)
    for _ in range(60):
        texts = [rnd.choice(["", " ", "\n"]) + " ".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 9))) for _ in range(rnd.randrange(1, 7))]
        ids, place = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(place, place[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_frequent_chunks_are_encoded_once():
    t, given = Tokenizer.from_file(FILE), []
    e = F.LibraryEncoder(FILE, cached=100)
    whole = e._whole
    e._whole = lambda texts: given.extend(texts) or whole(texts)
    common = [f"common{k}" for k in range(20)]
    for call in range(30):
        texts = [" ".join(["x", *common, *(f"fresh{call}q{k}" for k in range(30))]), "", "x\ncommon3 y"]
        ids, place = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(place, place[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(e.chunks) < 200
    words = " ".join(given).split(" ")
    assert [words.count(w) for w in common] == [1] * 20
