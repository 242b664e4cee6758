import base64
import hashlib

import public_tokenizers as P
import pytest
import samples
import tiktoken

from glyphloom.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, " ", "\n\n  x", "a" * 5000, "ab" * 700 + "!?" * 300, "it's we'll 12 345", "日本語のテキスト👩‍👩‍👧", "<|endoftext|>", "tab\t\t\tx   　y", "é" * 90, "x" * 64, "y" * 65]


def test_as_the_library(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD + [t for _, t in samples.rows(5)] + ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(df, FILE, P.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        stored = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(stored).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), t


def test_every_character_is_cut_as_the_library_cuts(library):
    encoder = bpe.Encoder(bpe.vocabulary(FILE).merge, P.PATTERN)
    points = [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x12000, 3), 0x1D7CE, 0x1F600, 0x2F800, 0xE0001, 0x10FFFF]
    texts = [f"a{c} {c}b  {c}1" for c in map(chr, points)]
    ids, place = encoder.encode(texts)
    odd = [hex(points[i]) for i, t in enumerate(texts) if ids[place[i] : place[i + 1]].tolist() != library.encode_ordinary(t)]
    assert odd == []


def test_columns(spark):
    df = spark.createDataFrame([(1, "héllo wörld", "k"), (2, None, None)], "doc_id long, text string, h string")
    back = bpe.decode(bpe.encode(df, FILE, P.PATTERN), FILE)
    assert back.columns == ["doc_id", "text", "h", "ids", "decoded"]
    assert [bytes(r.decoded).decode() for r in back.orderBy("doc_id").collect()] == ["héllo wörld", ""]
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("h", "IDS"), FILE, P.PATTERN)
    assert bpe.digests(df.limit(0), FILE, P.PATTERN).count() == 0
