"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that it links.

Texts are A-Z lower-cased; a document's set holds the 64-bit hashes of its distinct
n-word windows (of the whole word sequence, if there are fewer words).  Two documents link
if 100 * intersection >= percent * union.

1.  Document frequencies of all shingles are counted over all documents.  In every set,
    rarest first is the order.
2.  Two sets that link share at least k of the shingles in their k-prefixes, the first
    n - ceil(n * percent / 100) + k, for every k.  Each document takes the k with the least
    estimated cost: the postings that its prefix meets, and 1/k of them for verification.
    A pair is held to the smaller k of its two documents.  A document whose prefix has
    only shingles of its own links with nothing and goes no further.
3.  Candidates first meet one pivot a shingle: the document with the fewest shingles of its
    own, which of a family of near copies is the one nearest to all.  Each document is
    verified against the pivot that shares most prefix shingles with it; the links found
    give first groups.  Then documents of *different* groups that share enough prefix
    shingles are verified where they meet, and only which groups they join is handed on.  A
    group of near copies, however large, thus costs a few comparisons a copy, no table of
    pairs grows with the square of a group, and no link between different groups is lost.
4.  Connected components of all verified links.

Equal texts are found first, by a 128-bit hash: one block owns each, and only the owner's
first copy takes part; equal sets of texts that a block owns are represented by one as well.
Shingles that only copies of one text have thus count once.  Pairs are left out as soon as
places show that a link is impossible: one set has too few shingles that occur elsewhere,
too many before a shared one that the other cannot have, or too few in both prefixes for
what the rest of the sets could add.

Null and empty texts have empty sets and link with nothing.  Rows are told apart by
place, so rows with one doc_id or none are documents of their own; component_id is the
least doc_id of the component that is not null (null if there is none).  Other columns are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import components

MOST_SHARED = 16
COST_OF_CHECK = 200

SIGNATURES = "row long, doc_id long, h long, h2 long, owned boolean, n long, stands_for long, elsewhere int, prefix binary, k int, tokens binary"
_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("h2", pa.int64()), ("owned", pa.bool_()), ("n", pa.int64()), ("stands_for", pa.int64()), ("elsewhere", pa.int32()), ("prefix", pa.binary()), ("k", pa.int32()), ("tokens", pa.binary())])


def _sets(texts: tb.Texts, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, ascending."""
    for _, _, part in texts.chunks():
        data = tb.lower_ascii(part.data)
        words = tb.split_words(tb.Texts(data, part.start))
        hashes = tb.hash_words(data, words)
        windows = tb.hash_windows(hashes, size)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= size:
                own = np.sort(windows[a : b - size + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            else:
                yield tb.hash_windows(hashes[a:b], b - a, 2) if b > a else np.zeros(0, np.uint64)


def _distinct(block: tb.Block, size: int, owned: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets, and for each owned text the first owned text with an equal set; others stand for themselves."""
    sets, known = list(_sets(block.texts, size)), {}
    stands = np.array([known.setdefault(s.tobytes(), i) if len(s) and owned[i] else i for i, s in enumerate(sets)], np.int64)
    return sets, stands


def _owned(block: tb.Block, foreign: pa.Table) -> np.ndarray:
    """Whether this block owns each text; foreign names those that another block owns."""
    others = set(zip(foreign["h"].to_pylist(), foreign["h2"].to_pylist()))
    return np.array([(h, g) not in others for h, g in zip(block.hashes.tolist(), block.table["h2"].to_pylist())], bool)


def _free(n: int | np.ndarray, percent: int):
    """How many of n shingles a linked set may lack."""
    return n - (n * percent + 99) // 100


def _prefix(tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The cheapest multi-match prefix: its tokens in order, and how many of them must be shared."""
    n = len(tokens)
    order = np.lexsort((tokens, often))
    base, most = _free(n, percent), min(MOST_SHARED, n - _free(n, percent))
    met = np.cumsum(often[order[: base + most]] - 1)[base:]
    k = np.arange(1, most + 1)
    best = int(np.argmin(met + COST_OF_CHECK * met / k))
    return order[: base + best + 1], best + 1


def signatures(blocks: tb.Blocks, size: int, percent: int) -> DataFrame:
    """One row a document: number, set size, its stand-in's number; for candidates also prefix and set."""
    texts = blocks.docs.select("block", "h", "h2").distinct()
    owners = texts.groupBy("h", "h2").agg(F.min("block").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    foreign = texts.join(owners.toDF("h_", "h2_", "owner", "n"), (F.col("h") == F.col("h_")) & (F.col("h2") == F.col("h2_"))).where("block <> owner").select(F.col("block").alias("block"), F.col("h").alias("h"), F.col("h2").alias("h2"))
    foreign = tb.checkpointed(foreign)

    def keys_of(block: tb.Block, others: pa.Table):
        owned = _owned(block, others)
        sets, stands = _distinct(block, size, owned)
        own = [s for i, s in enumerate(sets) if stands[i] == i and owned[i]]
        return np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)

    repeated, n_buckets = tb.repeated_keys(blocks, keys_of, 1.3, foreign)
    beside = repeated.unionByName(foreign, allowMissingColumns=True)

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCHEMA.empty_table()
        block = tb.block_of(left)
        owned = _owned(block, right.filter(pa.compute.is_valid(right["h"])))
        sets, stands = _distinct(block, size, owned)
        if len(block.ids) > 1 << 24:
            raise ValueError("more than 2**24 rows are alike in id and text")
        number = block.number << 24
        ends = np.cumsum([len(s) for s in sets])
        often = tb.counts_in(np.concatenate(sets), right, n_buckets)
        prefixes, ks, tokens, elsewhere = [], [], [], []
        for i, (s, end) in enumerate(zip(sets, ends.tolist())):
            mine = often[end - len(s) : end]
            rare = int((mine < 2).sum())
            elsewhere.append(len(s) - rare)
            if stands[i] != i or not owned[i] or not len(s) or rare > _free(len(s), percent):
                prefixes.append(None), ks.append(None), tokens.append(None)
                continue
            order, k = _prefix(s, mine, percent)
            # a token's place counts; those of this document alone meet nothing and stay out
            shared = mine[order] >= 2
            made = np.zeros(int(shared.sum()), [("token", "<u8"), ("place", "<u4")])
            made["token"], made["place"] = s[order][shared], np.flatnonzero(shared)
            prefixes.append(made.tobytes()), ks.append(k), tokens.append(s.tobytes())
        n = [len(s) for s in sets]
        ints = lambda x, kind=pa.int64(): pa.array(x, kind)
        return pa.table([ints(number + np.arange(len(sets))), block.table["id"], ints(block.hashes), block.table["h2"], pa.array(owned), ints(n), ints(number + stands), ints(elsewhere, pa.int32()), pa.array(prefixes, pa.binary()), ints(ks, pa.int32()), pa.array(tokens, pa.binary())], schema=_SCHEMA)

    return blocks.docs.groupBy("block").cogroup(beside.groupBy("block")).applyInArrow(sign, SIGNATURES)


POSTINGS = "token long, row long, id long, label long, size long, n long, elsewhere long, place long, k long"
_KIND = np.dtype([("token", "<u8"), ("place", "<u4")])


def _postings(candidates: DataFrame) -> DataFrame:
    """One row for each token of a prefix; candidates has row, doc_id, n, elsewhere, k and prefix, and may have label and size."""
    names = [x.split()[0] for x in POSTINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, 50) for b in batches for low in range(0, b.num_rows, 50)):
            prefixes = [np.frombuffer(x.as_buffer(), _KIND) for x in batch["prefix"]]
            whole = np.concatenate([np.zeros(0, _KIND), *prefixes])
            at = pa.array(np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes]), pa.int64())
            made = {"token": pa.array(np.ascontiguousarray(whole["token"]).view(np.int64)), "place": pa.array(whole["place"].astype(np.int64))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch[c].take(at) for c in names], names)

    has = set(candidates.columns)
    id_ = F.coalesce("doc_id", F.lit(tb.NULL_ID)).alias("id")
    label = F.col("label" if "label" in has else "row").alias("label")
    size = (F.col("size") if "size" in has else F.lit(1)).cast("long").alias("size")
    return candidates.select("row", id_, label, size, F.col("n"), F.col("elsewhere").cast("long"), F.col("k").cast("long"), "prefix").mapInArrow(run, POSTINGS)


def _bounds(percent: int) -> dict[str, str]:
    """SQL for a pair of postings x and y of one token: what a link needs, and whether the two may belong to one.

    The sizes allow it; both sets have enough shingles that occur elsewhere; the token is in
    both prefixes of the pair's k, the smaller one; and neither set has too many shingles
    before it that the other cannot have before it too.  least: how many tokens of both
    prefixes must be shared, k or what the rest of the sets cannot supply.
    """
    need = f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    prefix = lambda t: f"least({t}.n, {t}.n - ({t}.n * {percent} + 99) div 100 + least(x.k, y.k))"
    early = lambda t, u: f"{t}.place - ({u}.place - ({u}.n - {u}.elsewhere)) <= {t}.n - {need}"
    may = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND least(x.elsewhere, y.elsewhere) >= {need} AND x.place < {prefix('x')} AND y.place < {prefix('y')} AND {early('x', 'y')} AND {early('y', 'x')}"
    return {"may": may, "least": f"greatest(least(x.k, y.k), {need} - greatest(x.n - {prefix('x')}, y.n - {prefix('y')}))"}


def _meetings(met: DataFrame, percent: int) -> DataFrame:
    """(a, b, least): pairs that may link and how many tokens they must share; met has a row for each token that two postings, x and y, share."""
    bounds = _bounds(percent)
    return met.where(bounds["may"]).select(F.expr("least(x.row, y.row)").alias("a"), F.expr("greatest(x.row, y.row)").alias("b"), F.expr(bounds["least"]).alias("least"))


def _enough(pairs: DataFrame) -> DataFrame:
    """(a, b, shared): pairs that share enough tokens."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("least").alias("least")).where("shared >= least").select("a", "b", "shared")


def _pivot_pairs(candidates: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): pairs of a document and a token's pivot that share enough tokens."""
    postings = _postings(candidates)
    pivot = F.min(F.struct((F.col("n") - F.col("elsewhere")).alias("own"), "id", "row", "n", "elsewhere", "place", "k")).alias("y")
    pivots = postings.groupBy("token").agg(pivot, F.count(F.lit(1)).alias("holders")).where("holders > 1").select("token", "y")
    return _enough(_meetings(postings.alias("x").join(pivots, "token").where("x.row <> y.row"), percent))


# ---------------------------------------------------------------- between groups

LARGE = 64
FEW = 8
PART_ROWS, PART_TOKENS = 1000, 250_000
DENSE = 64


def _shared(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of the first sets shares with each of the second.

    Tokens of many pairs are counted by products of 0/1 matrices, the others pair by pair.
    """
    out = np.zeros((len(first), len(second)), np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *first, *second])
    owner = np.repeat(np.arange(len(first) + len(second)), [len(s) for s in (*first, *second)])
    _, number = np.unique(tokens, return_inverse=True)
    left = owner < len(first)
    n = int(number.max()) + 1 if len(number) else 0
    pairs = np.bincount(number[left], minlength=n) * np.bincount(number[~left], minlength=n)
    often = np.flatnonzero(pairs > DENSE)
    place = np.full(n, -1)
    for low in range(0, len(often), 4096):
        some = often[low : low + 4096]
        place[:] = -1
        place[some] = np.arange(len(some))
        at = place[number]
        cells = np.zeros((len(first) + len(second), len(some)), np.float32)
        cells[owner[at >= 0], at[at >= 0]] = 1
        out += (cells[: len(first)] @ cells[len(first) :].T).astype(np.int64)
    rare = (pairs > 0) & (pairs <= DENSE)
    x, y = left & rare[number], ~left & rare[number]
    number_x, owner_x, number_y, owner_y = number[x], owner[x], number[y], owner[y] - len(first)
    order = np.argsort(number_y, kind="stable")
    number_y, owner_y = number_y[order], owner_y[order]
    low = np.searchsorted(number_y, number_x)
    count = np.searchsorted(number_y, number_x, "right") - low
    code = np.repeat(owner_x, count) * len(second) + owner_y[tb.ranges(low, count)]
    return out + np.bincount(code, minlength=out.size).reshape(out.shape) if len(code) else out


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the links a[i], b[i]."""
    names, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, top = number[: len(a)], number[len(a) :], np.arange(len(names))
    while (top[a] != top[b]).any():
        np.minimum.at(top, np.maximum(top[a], top[b]), np.minimum(top[a], top[b]))
        while (top[top] != top).any():
            top = top[top]
    moved = np.flatnonzero(top != np.arange(len(names)))
    return names[moved], names[top[moved]]


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows that are compared with each other; a part of a token's holders meets itself too."""
    left = table.filter(pa.compute.equal(table["side"], 0))
    alone = table["kind"][0].as_py() == 1 and table["mine"][0].as_py() == table["theirs"][0].as_py()
    return left, left if alone else table.filter(pa.compute.equal(table["side"], 1))


CELL = "kind long, key long, mine long, theirs long, side long, row long, other long, least long"
_CELL = pa.schema([(c.split()[0], pa.int64()) for c in CELL.split(", ")])


def _active(table: pa.Table, percent: int) -> pa.Table:
    """The pairs of a cell that may link, of different labels, by what the places of the cell's token tell.

    At most FEW pairs a row are named one by one (kind 2: row, other, and how many tokens
    they must share); else the rows that have such pairs.
    """
    x, y = _sides(table)
    col = lambda t, c: t[c].to_numpy().astype(np.int64)
    a, b = ({c: col(t, c) for c in ("label", "n", "elsewhere", "place", "k")} for t in (x, y))
    a = {c: v[:, None] for c, v in a.items()}
    may = (a["label"] != b["label"]) & _may_link(a, b, percent)
    if y is x:
        may = np.triu(may)
    i, j = np.nonzero(may)
    if len(i) <= FEW * (x.num_rows + y.num_rows):
        k, need, ends_a, ends_b = _ends({c: v[i, 0] for c, v in a.items()}, {c: v[j] for c, v in b.items()}, percent)
        least = np.maximum(k, need - np.maximum(a["n"][i, 0] - ends_a, b["n"][j] - ends_b))
        p, q = col(x, "row")[i], col(y, "row")[j]
        made = {"kind": np.full(len(i), 2), "row": np.minimum(p, q), "other": np.maximum(p, q), "least": least}
        return pa.table([pa.array(made.get(f.name, np.zeros(len(i))).astype(np.int64)) for f in _CELL], schema=_CELL)
    out = x.filter(pa.array(may.any(1) | may.any(0) if y is x else may.any(1)))
    if y is not x:
        out = pa.concat_tables([out, y.filter(pa.array(may.any(0)))])
    zero = pa.array(np.zeros(out.num_rows, np.int64))
    return pa.table([out[f.name].cast(pa.int64()) if f.name in out.column_names else zero for f in _CELL], schema=_CELL)


def _ends(a: dict, b: dict, percent: int):
    """Of pairs: the smaller k, the intersection that a link needs, and both prefix lengths for that k."""
    k, need = np.minimum(a["k"], b["k"]), -(-percent * (a["n"] + b["n"]) // (100 + percent))
    return k, need, *(np.minimum(t["n"], _free(t["n"], percent) + k) for t in (a, b))


def _may_link(a: dict, b: dict, percent: int) -> np.ndarray:
    """Whether pairs of postings of one token may belong to a link, as in `_bounds`."""
    _, need, ends_a, ends_b = _ends(a, b, percent)
    ok = (100 * np.minimum(a["n"], b["n"]) >= percent * np.maximum(a["n"], b["n"])) & (np.minimum(a["elsewhere"], b["elsewhere"]) >= need)
    early = lambda t, u: t["place"] - (u["place"] - (u["n"] - u["elsewhere"])) <= t["n"] - need
    return ok & (a["place"] < ends_a) & (b["place"] < ends_b) & early(a, b) & early(b, a)


def _links_between(x: pa.Table, y: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels that links between rows of x and rows of y join, as a forest.

    Pairs of different labels that share enough tokens of their prefixes have their whole
    sets compared.
    """
    col = lambda t, c: t[c].to_numpy().astype(np.int64)
    prefixes = lambda t: [np.frombuffer(p.as_buffer(), _KIND)["token"] for p in t["prefix"]]
    a, b = ({c: col(t, c) for c in ("label", "n", "elsewhere", "k")} for t in (x, y))
    a = {c: v[:, None] for c, v in a.items()}
    k, need, ends_a, ends_b = _ends(a, b, percent)
    may = (a["label"] != b["label"]) & (100 * np.minimum(a["n"], b["n"]) >= percent * np.maximum(a["n"], b["n"])) & (np.minimum(a["elsewhere"], b["elsewhere"]) >= need)
    if may.any():
        may &= _shared(prefixes(x), prefixes(y)) >= np.maximum(k, need - np.maximum(a["n"] - ends_a, b["n"] - ends_b))
    i, j = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sets = lambda t, at: [np.frombuffer(t["tokens"][r].as_buffer(), np.uint64) for r in at.tolist()]
    both = _shared(sets(x, i), sets(y, j))
    linked = may[np.ix_(i, j)] & (100 * both >= percent * (a["n"][i] + b["n"][j] - both))
    p, q = np.nonzero(linked)
    return _joined(a["label"][i[p], 0], b["label"][j[q]])


def _label_links(candidates: DataFrame, labelled: DataFrame, percent: int, written: tb.Written) -> DataFrame:
    """(a, b): labels of which some members link, enough of them to connect all that do.

    Only tokens that documents of different labels share are looked at.  A label with
    LARGE members or more is visited by documents of smaller labels.  Members of small
    labels meet in the token: pairs are counted over tokens while they are FEW a row, else
    the whole sets of those that may link are compared.  Members and visitors, and the holders of a token, are dealt
    into parts of bounded size; a task compares one part with another and hands on a forest
    of the links between labels, never their pairs.
    """
    size = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens_in"))
    sized = written(labelled.join(size, "label"))
    postings = _postings(candidates.select("row", "prefix").join(sized, "row"))
    small = F.col("size") < LARGE
    tokens = written(postings.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if(small).alias("few"), F.sum(F.when(small, F.col("n")).otherwise(0)).alias("few_tokens")).where("low <> high").select("token", "few", "few_tokens"))
    mixed = written(postings.join(tokens, "token"))
    ceil = lambda rows, held: F.greatest(F.ceil(F.col(rows) / PART_ROWS), F.ceil(F.col(held) / PART_TOKENS)).cast("int")
    part = lambda parts: F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    # visits of larger labels, which a member of fitting size might answer
    order = lambda t: F.struct(f"{t}.size", f"{t}.label")
    hosts = mixed.where(~small).groupBy("token", "label", "size").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"))
    fits = (F.col("shortest") * percent <= F.col("x.n") * 100) & (F.col("x.n") * percent <= F.col("longest") * 100)
    met = mixed.alias("x").join(hosts.alias("h"), "token").where((order("x") < order("h")) & fits)
    visits = written(met.select(F.col("x.row").alias("row"), F.col("x.n").alias("n"), F.col("h.label").alias("label")).distinct())
    come = visits.groupBy("label").agg(F.count(F.lit(1)).alias("guests"), F.sum("n").alias("guest_tokens"))
    parts = come.join(size, "label").select("label", ceil("size", "tokens_in").alias("m"), ceil("guests", "guest_tokens").alias("v"))
    where = ["kind", "key", "mine", "theirs", "side", "row"]
    members = labelled.select("row", "label").join(parts, "label").select(F.lit(0).alias("kind"), F.col("label").alias("key"), part("m").alias("mine"), every("v").alias("theirs"), F.lit(0).alias("side"), "row")
    guests = visits.select("row", "label").join(parts, "label").select(F.lit(0).alias("kind"), F.col("label").alias("key"), every("m").alias("mine"), part("v").alias("theirs"), F.lit(1).alias("side"), "row")

    # small labels in one token; only those that may link with one of another label go on
    holders = mixed.where(small & (F.col("few") > 2 * FEW)).withColumn("parts", ceil("few", "few_tokens")).withColumn("own", part("parts")).withColumn("other", every("parts"))
    dealt = holders.select(F.lit(1).alias("kind"), F.col("token").alias("key"), F.least("own", "other").alias("mine"), F.greatest("own", "other").alias("theirs"), (F.col("own") > F.col("other")).cast("int").alias("side"), "row", "label", "n", "elsewhere", "place", "k")
    cells = written(dealt.groupBy("kind", "key", "mine", "theirs").applyInArrow(lambda t: _active(t, percent), CELL))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        a, b = _links_between(*_sides(table), percent)
        return pa.table([pa.array(a), pa.array(b)], schema=schema)

    # whole sets are read for the rows that meet others only
    meetings = written(members.select(*where).unionByName(guests.select(*where)).unionByName(cells.where("kind = 1").select(*where)))
    data = candidates.select("row", "prefix", "tokens").join(written(meetings.select("row").distinct()), "row", "left_semi").join(sized.select("row", "label", "n", "elsewhere", "k"), "row")
    found = meetings.join(data, "row").groupBy("kind", "key", "mine", "theirs").applyInArrow(compare, "a long, b long")
    few = mixed.where(small & (F.col("few") <= 2 * FEW))
    few = _meetings(few.alias("x").join(few.alias("y"), "token").where("x.row < y.row AND x.label <> y.label"), percent)
    pairs = _enough(few.unionByName(cells.where("kind = 2").select(F.col("row").alias("a"), F.col("other").alias("b"), "least")))
    name = labelled.select("row", "label")
    near = _verified(pairs, candidates, percent, written).join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return written(found.unionByName(near).distinct())


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int, written: tb.Written) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    pairs = written(pairs.select("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok))

    rows = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    sets = candidates.select("row", "tokens").join(rows, "row", "left_semi")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.mapInArrow(run, "a long, b long")


def _grouped(blocks: tb.Blocks, percent: int, size: int) -> DataFrame:
    """row, doc_id, h, n and group for each document; row is block and place in it, group the number of one of its rows."""
    written = tb.Written(blocks.docs)
    signed = written(signatures(blocks, size, percent))
    candidates = signed.where("prefix is not null")
    near = _pivot_pairs(candidates, percent)
    # one pivot for each document, the one that shares most; both ends may play that part
    ends = near.select(F.col("a").alias("row"), F.col("b").alias("other"), "shared").unionByName(near.select(F.col("b").alias("row"), F.col("a").alias("other"), "shared"))
    best = ends.groupBy("row").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    chosen = best.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()
    first = components(_verified(chosen, candidates, percent, written)).toDF("row", "label")
    labelled = written(candidates.select("row", "doc_id", "n", "elsewhere", "k").join(first, "row", "left").withColumn("label", F.coalesce("label", "row")))
    joined = components(_label_links(candidates, labelled, percent, written)).toDF("label", "group")
    groups = labelled.select("row", "label").join(joined, "label", "left").select(F.col("row").alias("stands_for"), F.coalesce("group", "label").alias("group"))
    rows = signed.select("row", "doc_id", "h", "h2", "owned", "n", "stands_for")
    # a copy whose text another block owns stands where the owner's copies stand
    elsewhere = rows.where("not owned").select("h", "h2").distinct()
    owner = rows.where("owned").join(elsewhere, ["h", "h2"], "left_semi").groupBy("h", "h2").agg(F.min("stands_for").alias("copy_of"))
    rows = rows.join(owner, ["h", "h2"], "left").withColumn("stands_for", F.when(~F.col("owned") & (F.col("n") > 0), F.col("copy_of")).otherwise(F.col("stands_for")))
    return rows.join(groups, "stands_for", "left").select("row", "doc_id", "h", "n", F.coalesce("group", "stands_for").alias("group"))


def _second_hash(text_col: str):
    return F.xxhash64(F.lit(5), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def linked_groups(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for each document."""
    grouped = _grouped(tb.blocks_of(docs, id_col, text_col, {"h2": _second_hash(text_col)}), percent, size)
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "group").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """The documents, with all their columns, of which none with less id is linked to them; docs has doc_id and text.

    Of rows equal in id and text one stays; documents without words all stay.
    """
    rows = tb.WholeRows(docs, "text")
    blocks = tb.blocks_of(docs, extra={"h2": _second_hash("text"), "row": rows.struct()})
    grouped = tb.checkpointed(_grouped(blocks, percent, size).where("n > 0").withColumn("doc_id", F.coalesce("doc_id", F.lit(tb.NULL_ID))))
    first = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "h", "row")).alias("least"))
    lost = grouped.join(first, "group").where("row <> least.row").select(F.shiftright("row", 24).alias("block"), F.col("row").bitwiseAND(F.lit((1 << 24) - 1)).alias("place"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows.empty()
        block = tb.block_of(left)
        keep = np.ones(len(block.texts), bool)
        keep[right["place"].to_numpy()] = False
        return pa.table(rows.columns_of(block.table)).filter(pa.array(keep))

    return blocks.docs.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(finish, docs.schema)
