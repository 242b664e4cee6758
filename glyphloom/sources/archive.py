"""Archives of machines: a Parquet table with one row a key, and an exporter for grammar modules."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError, StorageError
from ..labels import GENERATED, SymbolTable, merge_generated
from ..operators.machine import Arc, Machine, machine, relabel_pairs
from ..semiring import semiring

SCHEMA = "key string, semiring string, start long, finals array<struct<state: long, weight: double>>, arcs array<struct<src: long, ilabel: long, olabel: long, weight: double, dst: long>>, n_states long, names map<long, string>"
TYPES = ("default", "stlist", "sttable", "fst", "sstable")


def _row(key: str, m: Machine) -> tuple:
    used = {x for _, a in m.all_arcs() for x in (a.ilabel, a.olabel)}
    names = {k: s for k, s in GENERATED if k in used}
    return key, m.semiring.name, m.start, [(s, w) for s, w in m.finals.items()], [(s, a.ilabel, a.olabel, float(a.weight), a.to) for s, a in m.all_arcs()], m.num_states(), names


def _machine(row) -> Machine:
    m = Machine(semiring(row.semiring), row.start, [[] for _ in range(row.n_states)], {f.state: f.weight for f in row.finals})
    for a in row.arcs:
        m.arcs[a.src].append(Arc(a.ilabel, a.olabel, a.weight, a.dst))
    moved = merge_generated(SymbolTable("read", (row.names or {}).items()))
    return relabel_pairs(m, moved, moved) if moved else m


class Archive:
    """Machines by key.  `r` reads, `w` collects and writes sorted keys at close; the kind is accepted and ignored."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r", arc_type: str = "standard", kind: str = "default"):
        if mode not in ("r", "w"):
            raise ArgumentError(f"unknown mode: {mode}")
        if kind not in TYPES:
            raise ArgumentError(f"unknown kind of archive: {kind}")
        self.spark, self.name, self.mode, self.far_type, self.closed = spark, path, mode, kind, False
        self.semiring, self._made = semiring(arc_type), {}
        if mode == "r":
            try:
                self.table: DataFrame = spark.read.parquet(*path.split(","))
                self.table.schema["key"]
            except Exception as e:
                raise StorageError(f"cannot read {path}") from e

    def _must(self, mode: str) -> None:
        if self.closed or self.mode != mode:
            raise ArgumentError(f"the archive is not open for {'reading' if mode == 'r' else 'writing'}")

    # -- reading: filters on the key reach the Parquet scan

    def keys(self) -> list[str]:
        self._must("r")
        return [r.key for r in self.table.select("key").orderBy("key").collect()]

    def find(self, key: str) -> str | None:
        """The first key that is not before this one."""
        self._must("r")
        return self.table.where(F.col("key") >= key).agg(F.min("key")).first()[0]

    def __contains__(self, key: str) -> bool:
        self._must("r")
        return not self.table.where(F.col("key") == key).isEmpty()

    def __getitem__(self, key: str) -> Machine:
        self._must("r")
        found = self.table.where(F.col("key") == key).limit(1).collect()
        if not found:
            raise KeyError(key)
        return _machine(found[0])

    def __iter__(self):
        self._must("r")
        return ((r.key, _machine(r)) for r in self.table.orderBy("key").toLocalIterator())

    # -- writing

    def __setitem__(self, key: str, value) -> None:
        self._must("w")
        m = machine(value)
        if m.semiring != self.semiring:
            raise ArgumentError(f"the archive holds {self.semiring.name} machines")
        if key in self._made:
            raise ArgumentError(f"key used twice: {key}")
        self._made[key] = m

    add = __setitem__

    def close(self) -> None:
        if self.mode == "w" and not self.closed:
            rows = [_row(k, m) for k, m in sorted(self._made.items())]
            self.spark.createDataFrame(rows, SCHEMA).repartition(1).sortWithinPartitions("key").write.parquet(self.name)
        self.closed = True

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()


class Exporter(Archive):
    """An archive that is written key by key, like a dictionary."""

    def __init__(self, spark: SparkSession, path: str, arc_type: str = "standard", kind: str = "default"):
        super().__init__(spark, path, "w", arc_type, kind)


def run(generator, args: list[str] | None = None) -> None:
    """Command line of a grammar module: generator(exporter), or generator({name: exporter}) for name=path,name=path."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--output", required=True, help="a path, or name=path,name=path")
    parser.add_argument("--arc_type", default="standard")
    parser.add_argument("--far_type", default="default")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    parts = dict(p.split("=", 1) for p in given.output.split(",")) if "=" in given.output else None
    if parts is None:
        with Exporter(spark, given.output, given.arc_type, given.far_type) as out:
            generator(out)
        return
    made = {n: Exporter(spark, p, given.arc_type, given.far_type) for n, p in parts.items()}
    generator(made)
    for out in made.values():
        out.close()
