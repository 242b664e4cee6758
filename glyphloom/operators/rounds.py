"""What fixpoints over tables share: written rounds, tables that grow by rounds, numbers for keys, contracted chains.

Rounds are written in the shared folder and read back, so lineage is cut, a lost executor costs
no more than its round, and the planner knows the sizes of what it joins.  A round writes only
what it has found; the driver learns whether that is anything.  What is sent to all tasks
passes through the driver, so written tables say how they are joined: small ones are sent,
others never, however small their files are.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

from ..errors import OperationError

MOST_PARTS = 12
FEW_NUMBERS = 1 << 17  # a table of so many is sent to all tasks that join it: a megabyte


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one on a single machine only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise OperationError("spark.checkpoint.dir has to name a folder that all nodes reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def joined_by_size(df: DataFrame, numbers: int) -> DataFrame:
    """The table with a hint for its joins: to be sent to all tasks if it is small, else to be dealt by the key and merged."""
    return df.hint("broadcast" if numbers <= FEW_NUMBERS else "merge")


def _numbers(field: StructField) -> Column:
    """How many numbers a value is."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, ArrayType):
        return F.lit(1) + F.coalesce(F.size(c), F.lit(0))
    if isinstance(field.dataType, StringType | BinaryType):
        return F.lit(1) + F.coalesce(F.octet_length(c), F.lit(0)) / 8
    return F.lit(1)


class _Counts:
    """Rows and numbers of a table, seen while it is written."""

    def __init__(self, df: DataFrame):
        self._seen = Observation()
        numbers = reduce(Column.__add__, [_numbers(f) for f in df.schema])
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("n"), F.sum(numbers).cast("long").alias("numbers"))

    def get(self) -> tuple[int, int]:
        seen = self._seen.get
        return seen["n"], seen["numbers"] or 0


class Rounds:
    """Tables of one computation, each written once; `done` keeps its result and deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.counted(df)[0]

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The table as written, and its number of rows."""
        table, n, numbers = self.written(df)
        return joined_by_size(table, numbers), n

    def written(self, df: DataFrame) -> tuple[DataFrame, int, int]:
        """The table without a hint for joins, its number of rows, and of numbers in them."""
        self.n += 1
        counts = _Counts(df)
        counts.df.write.parquet(f"{self.top}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{self.n}"), *counts.get()

    def done(self, *results: DataFrame) -> list[DataFrame]:
        counts = [_Counts(df) for df in results]
        kept = [joined_by_size(checkpointed(c.df), c.get()[1]) for c in counts]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return kept


class Growing:
    """Rows by key, added round by round; `new` are those of the last round.

    The parts of the rounds are joined into one now and then, so their number stays small and
    a row is written again a few times only.
    """

    def __init__(self, rounds: Rounds, keys: list[str], first: DataFrame):
        self.rounds, self.keys = rounds, keys
        self.parts, self.numbers = [], 0
        self._write(first)

    def _write(self, rows: DataFrame) -> None:
        table, self.n_new, numbers = self.rounds.written(rows)
        self.new = joined_by_size(table, numbers)
        if self.n_new or not self.parts:
            self.parts.append(table)
            self.numbers += numbers

    def _replace(self, rows: DataFrame) -> None:
        table, _, self.numbers = self.rounds.written(rows)
        self.parts = [table]

    @property
    def all(self) -> DataFrame:
        return joined_by_size(reduce(DataFrame.unionByName, self.parts), self.numbers)

    def add(self, found: DataFrame) -> bool:
        """Keep the rows whose key was not there; false if there are none.  One row a key, please."""
        return self.put(found.join(self.all.select(*self.keys), self.keys, "left_anti"))

    def put(self, rows: DataFrame) -> bool:
        """Keep all rows."""
        self._write(rows)
        if not self.n_new:
            return False
        if len(self.parts) > MOST_PARTS:
            self._replace(self.all)
        return True


class Improving(Growing):
    """One row a key, the one with the least `order`; a better row takes the place of a worse one."""

    def __init__(self, rounds: Rounds, keys: list[str], first: DataFrame, order: list[str], margin: float = 0.0):
        self.order, self.margin = order, margin
        super().__init__(rounds, keys, first)

    @property
    def best(self) -> DataFrame:
        rest = [c for c in self.new.columns if c not in self.keys and c not in self.order]
        row = F.min(F.struct(*self.order, *rest)).alias("_r")
        return self.all.groupBy(*self.keys).agg(row).select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in (*self.order, *rest)])

    def add(self, found: DataFrame) -> bool:
        """Keep what is new or better by more than the margin."""
        had = self.all.groupBy(*self.keys).agg(F.min(self.order[0]).alias("_had"))
        better = found.join(had, self.keys, "left").where(F.col("_had").isNull() | (F.col(self.order[0]) < F.col("_had") - self.margin)).drop("_had")
        return self.put(better)

    def put(self, rows: DataFrame) -> bool:
        kept = super().put(rows)
        if kept and len(self.parts) == 1:
            self._replace(self.best)
        return kept


def numbered(rounds: Rounds, keys: DataFrame, name: str = "number", first: int = 0, distinct: bool = True) -> DataFrame:
    """Distinct rows with numbers from `first` up in the order of partitions, without a task that sees all rows."""
    marked = rounds((keys.distinct() if distinct else keys).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    offset, offsets = first, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(offset)]
        offset += sizes[p]
    base = F.create_map(*offsets)[part] if offsets else F.lit(first)
    return marked.select(*keys.columns, (base + place).cast("long").alias(name))


def chains(rounds: Rounds, steps: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Contract states with one way in and one way out; None where few states are such.

    steps (u, v, w, n): one row a pair of states; kept (state): not to be contracted.
    Returns core steps (u, v, w, n, chain) and (state, chain, u, w, n): each contracted state with
    the core state that its chain begins at, and weight and steps from there.  Pointers double at
    each round, so a chain of n states takes log n rounds.
    """
    one = lambda c: steps.groupBy(F.col(c).alias("state")).count().where("count = 1").select("state")
    inner, n_inner = rounds.counted(one("v").join(one("u"), "state").join(kept.select("state").distinct(), "state", "left_anti"))
    if n_inner < 64:
        return None
    out = inner.join(steps.withColumnRenamed("u", "state"), "state")
    now = rounds(out.select("state", F.col("state").alias("chain"), F.col("v").alias("to"), "w", "n", F.lit(True).alias("open")))
    for _ in range(n_inner.bit_length() + 1):
        ahead = now.select(F.col("state").alias("to"), F.col("chain").alias("c2"), F.col("to").alias("t2"), F.col("w").alias("w2"), F.col("n").alias("n2"))
        now = rounds(now.join(ahead, "to", "left").select("state", F.coalesce("c2", "chain").alias("chain"), F.coalesce("t2", "to").alias("to"), (F.col("w") + F.coalesce("w2", F.lit(0.0))).alias("w"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.col("t2").isNotNull().alias("open")))
        if now.where("open").isEmpty():
            break
    now = rounds(now.where("not open").drop("open"))  # what is still open is a ring that nothing leads into; it stays as it is
    inner = now.select("state")
    into = steps.join(inner.withColumnRenamed("state", "u"), "u", "left_anti")
    heads = into.select("u", F.col("v").alias("state"), F.col("w").alias("w1"), F.col("n").alias("n1")).join(now, "state")
    heads = rounds(heads.select("u", "chain", F.col("to").alias("v"), (F.col("w1") + F.col("w")).alias("w"), (F.col("n1") + F.col("n")).alias("n")))
    direct = into.join(inner.withColumnRenamed("state", "v"), "v", "left_anti").withColumn("chain", F.lit(None).cast("long"))
    core = rounds(heads.unionByName(direct.select(*heads.columns)))
    whole = heads.select("chain", "u", F.col("w").alias("whole"), F.col("n").alias("steps"))
    inside = rounds(now.join(whole, "chain").select("state", "chain", "u", (F.col("whole") - F.col("w")).alias("w"), (F.col("steps") - F.col("n")).alias("n")))
    return core, inside
