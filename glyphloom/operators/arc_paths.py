"""Best paths and random paths of arc tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..semiring import INFINITY
from .arcs import ArcTable
from .rounds import Growing, Rounds

_ID = ["i1", "i2", "o1", "o2"]
PATHS = "rank int, ilabels array<long>, olabels array<long>, weight double"


class _Lists(Growing):
    """The best ways from each state to an end; a state's last list counts."""

    def __init__(self, rounds: Rounds, first: DataFrame):
        super().__init__(rounds, [], first)

    @property
    def current(self) -> DataFrame:
        last = self.all.groupBy("state").agg(F.max("version").alias("version"))
        return self.all.join(last, ["state", "version"])

    def put(self, rows: DataFrame) -> bool:
        kept = super().put(rows)
        if kept and len(self.parts) == 1:
            self._replace(self.current.select(*self.new.columns))
        return kept


def best_paths(t: ArcTable, n: int = 1, unique: bool = False) -> DataFrame:
    """(rank, ilabels, olabels, weight) of the n best paths; with `unique`, of the n best different pairs of strings.

    Each state keeps a list of its n best ways to an end, each known by 128 bits that stand for
    its arcs (or, with `unique`, for what it reads and writes) and by the arc that it begins with.
    A round sends ways that are new over the arcs that lead to their states; lists that change
    are written anew.  Ways that with the least weight from the start exceed the n-th best path
    found so far are dropped.  At the end the arcs of the n paths are read out by joins.

    Ways of equal weight are taken by fewer arcs, then by those bits, so that silent or free
    cycles end.  A negative cycle is an error.
    """
    if n < 1:
        raise ArgumentError("at least one path, please")
    t.semiring.require_best_path("best paths")
    t = t.connect()
    fore = t.shortestdistance()
    rounds = Rounds(t.arcs.sparkSession)
    fore = rounds(fore.select("state", F.col("distance").alias("fore")))
    arcs = rounds(t.arcs.select(F.monotonically_increasing_id().alias("arc"), "src", "ilabel", "olabel", "weight", F.col("dst").alias("state")))
    start = t.states.where("is_start").select("state").first()
    if start is None:
        return t.arcs.sparkSession.createDataFrame([], PATHS)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    first = t.states.where("final_weight is not null").select("state", F.lit(0).alias("version"), F.col("final_weight").alias("w"), zero.alias("hops"), *[zero.alias(c) for c in _ID], none.alias("arc"), none.alias("next"), *[zero.alias(f"n_{c}") for c in _ID], F.lit(True).alias("fresh"))
    lists = _Lists(rounds, first)
    known, new, version, bound = [c for c in first.columns if c not in ("version", "fresh")], lists.new, 0, INFINITY
    most = 1 + n * (1 + t.states.count())

    def longer(c: str) -> F.Column:
        salt = F.lit(_ID.index(c))
        if unique:
            label = F.col("ilabel" if c[0] == "i" else "olabel")
            return F.when(label == 0, F.col(f"n_{c}")).otherwise(F.xxhash64(salt, label, F.col(f"n_{c}"))).alias(c)
        return (F.xxhash64(salt, "a", F.col(f"n_{c}")) if c[0] == "i" else zero).alias(c)

    while lists.n_new:
        version += 1
        ahead = new.select(F.col("state").alias("next"), F.col("w").alias("rest"), F.col("hops").alias("h"), *[F.col(c).alias(f"n_{c}") for c in _ID])
        found = ahead.join(arcs.select(F.col("arc").alias("a"), F.col("src").alias("state"), "ilabel", "olabel", "weight", F.col("state").alias("next")), "next")
        found = found.select("state", (F.col("rest") + F.col("weight")).alias("w"), (F.col("h") + 1).alias("hops"), *[longer(c) for c in _ID], F.col("a").alias("arc"), "next", *[f"n_{c}" for c in _ID])
        if bound < INFINITY:
            found = found.join(fore, "state").where(F.col("fore") + F.col("w") <= bound + 1e-9).drop("fore")
        found = rounds(found)
        current = lists.current.select(*known).join(found.select("state").distinct(), "state", "left_semi")
        both = current.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
        rest = [c for c in known if c not in ("state", *_ID, "w", "hops")]
        one = both.groupBy("state", *_ID).agg(F.min(F.struct("w", "hops", "fresh", *rest)).alias("r")).select("state", *_ID, "r.*")
        rank = F.row_number().over(Window.partitionBy("state").orderBy("w", "hops", *_ID))
        top = one.withColumn("k", rank).where(F.col("k") <= n).drop("k")
        changed = top.where("fresh").select("state").distinct()
        kept = top.join(changed, "state", "left_semi").withColumn("version", F.lit(version))
        if not lists.put(kept.select(*first.columns)):
            break
        new = lists.new.where("fresh")
        lists.n_new = 1 if not new.isEmpty() else 0
        at_start = lists.current.where(F.col("state") == start["state"]).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).first()
        if at_start["n"] >= n:
            bound = at_start["w"]
        if version > most:
            raise ArgumentError("a negative cycle has no best path")
    table = rounds(lists.current.select("state", *_ID, "w", "hops", "arc", "next", *[f"n_{c}" for c in _ID]))
    rank = F.row_number().over(Window.orderBy("w", "hops", *_ID)).alias("rank")  # n rows
    none = F.array().cast("array<long>")
    now = rounds(table.where(F.col("state") == start["state"]).orderBy("w", "hops", *_ID).limit(n).select(rank, F.col("w").alias("weight"), "state", *_ID, none.alias("ilabels"), none.alias("olabels")))
    found = Growing(rounds, [], now.select("rank", "ilabels", "olabels", "weight").limit(0))
    say = lambda c, so_far: F.when(F.col(c) == 0, F.col(so_far)).otherwise(F.concat(F.col(so_far), F.array(c))).alias(so_far)
    labels = arcs.select("arc", "ilabel", "olabel")
    while True:
        at = rounds(now.join(table, ["state", *_ID]).join(labels, "arc", "left"))
        found.put(at.where("arc is null").select("rank", "ilabels", "olabels", "weight"))
        now, left = rounds.counted(at.where("arc is not null").select("rank", "weight", F.col("next").alias("state"), *[F.col(f"n_{c}").alias(c) for c in _ID], say("ilabel", "ilabels"), say("olabel", "olabels")))
        if not left:
            return rounds.done(found.all.select("rank", "ilabels", "olabels", "weight"))[0]


def number_of(*parts) -> F.Column:
    """A number from 0 to below 1 that depends on nothing but the parts: 52 bits of a digest of them."""
    text = F.concat_ws("/", *[p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def choices(t: ArcTable, select: str = "uniform") -> DataFrame:
    """(state, cells, cell, low, high, ilabel, olabel, dst): what can be drawn at each state and the interval that draws it.

    The masses of a state's arcs, and of its end where it is final, are laid side by side in the
    order of a digest of the choice.  Sums run within the digest's first digits and over them, so
    no task sees all arcs of a large state; each interval is listed by the cells that it meets.
    A state has as many cells as choices, so a state lists fewer rows than three a choice.
    """
    if select not in ("uniform", "log_prob"):
        raise ArgumentError(f"unknown way to draw: {select}")
    none = F.lit(None).cast("long")
    ways = t.arcs.select(F.col("src").alias("state"), "ilabel", "olabel", "weight", "dst")
    ends = t.states.where("final_weight is not null").select("state", none.alias("ilabel"), none.alias("olabel"), F.col("final_weight").alias("weight"), none.alias("dst"))
    mass = F.lit(1.0) if select == "uniform" else F.exp(-F.col("weight"))
    key = F.md5(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("end")) for c in ("ilabel", "olabel", "dst")]))
    all_of = ways.unionByName(ends).select("state", "ilabel", "olabel", "dst", mass.alias("mass"), key.alias("key")).withColumn("head", F.substring("key", 1, 3))
    heads = all_of.groupBy("state", "head").agg(F.sum("mass").alias("m"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("state").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("state", "head", F.coalesce(F.sum("m").over(before), F.lit(0.0)).alias("base"), F.sum("m").over(Window.partitionBy("state")).alias("whole"), F.sum("n").over(Window.partitionBy("state")).alias("cells"))
    up_to = Window.partitionBy("state", "head").orderBy("key", "mass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = all_of.withColumn("reach", F.sum("mass").over(up_to)).join(heads, ["state", "head"])
    laid = laid.select("state", "cells", "ilabel", "olabel", "dst", ((F.col("base") + F.col("reach") - F.col("mass")) / F.col("whole")).alias("low"), ((F.col("base") + F.col("reach")) / F.col("whole")).alias("high"))
    first, last = _cell("low"), _cell("high")
    return laid.withColumn("cell", F.explode(F.sequence(first, F.greatest(first, last))))


def _cell(at: str) -> F.Column:
    """The cell of a place from 0 to 1 among those of its state."""
    return F.least(F.floor(F.col(at) * F.col("cells")), F.col("cells") - 1)


def random_paths(t: ArcTable, n: int, select: str = "uniform", seed: int = 0, max_length: int | None = None) -> DataFrame:
    """(sample, ilabels, olabels) of n random paths, each step drawn among the arcs and the end of its state.

    `uniform` draws each with equal odds, `log_prob` by exp(-weight).  The number that draws a
    step depends on seed, sample and step alone, so a task that is computed again draws alike.
    Paths of more than max_length arcs are left out.
    """
    t = t.connect()
    rounds = Rounds(t.arcs.sparkSession)
    table = rounds(choices(t, select))
    cells = rounds(table.where("cell = 0").select("state", "cells").distinct())
    start = t.states.where("is_start").select("state").first()
    none = F.array().cast("array<long>")
    spark = t.arcs.sparkSession
    now = spark.range(n if start is not None else 0).select(F.col("id").alias("sample"), F.lit(start["state"] if start is not None else 0).cast("long").alias("state"), none.alias("ilabels"), none.alias("olabels"))
    found = Growing(rounds, [], now.select("sample", "ilabels", "olabels").limit(0))
    say = lambda c, so_far: F.when(F.col(c) == 0, F.col(so_far)).otherwise(F.concat(F.col(so_far), F.array(c))).alias(so_far)
    step, left = 0, n if start is not None else 0
    while left and (max_length is None or step <= max_length):
        drawn = now.join(cells, "state").withColumn("u", number_of(seed, F.col("sample"), step)).withColumn("cell", _cell("u")).drop("cells")
        drawn = rounds(drawn.join(table, ["state", "cell"]).where((F.col("low") <= F.col("u")) & (F.col("u") < F.col("high"))))
        found.put(drawn.where("dst is null").select("sample", "ilabels", "olabels"))
        now, left = rounds.counted(drawn.where("dst is not null").select("sample", F.col("dst").alias("state"), say("ilabel", "ilabels"), say("olabel", "olabels")))
        step += 1
    return rounds.done(found.all)[0]
