"""Rules on string columns: the compiled rule goes to the tasks, strings pass in Arrow batches.

Ranking happens where the candidates are made, since those of one row never need another
row: no shuffle, and only the rows asked for leave the kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, RewriteError
from ..labels import GENERATED, label_of_name, to_labels, to_text
from ..semiring import FINE_DELTA
from .rules import outputs_of

CHOICES = ("all", "top", "optimal", "one")


def _found(text, rule, kind, choice: str, n: int) -> list[tuple[str, float]]:
    made = outputs_of(rule, to_labels(text, kind))
    ranked = sorted(((to_text(o, kind), w) for o, w in made.items()), key=lambda x: (x[1], x[0]))
    if choice == "top":
        return ranked[:n]
    if choice in ("optimal", "one"):
        best = [c for c in ranked if c[1] <= ranked[0][1] + FINE_DELTA]
        if choice == "one" and len(best) > 1:
            raise RewriteError(f"several best outputs of {text!r}: {best[0][0]}, {best[1][0]}")
        return best
    return ranked


def candidates_of(df: DataFrame, column: str, rule, choice: str = "all", n: int = 1, strict: bool = False, token_type: str | None = None) -> DataFrame:
    """df with `candidates` array<struct<ostring, weight>> and `error`.

    Where a row has no output, or more than the one asked for, candidates is empty and error
    says why; strict fails instead.  A null string has no candidates and no error.
    """
    if choice not in CHOICES:
        raise ArgumentError(f"unknown choice: {choice}")
    if {"candidates", "error"} & {c.lower() for c in df.columns}:
        raise ArgumentError("the table has a column candidates or error already")
    cell = T.ArrayType(T.StructType([T.StructField("ostring", T.StringType()), T.StructField("weight", T.DoubleType())]))
    kind = pa.list_(pa.struct([("ostring", pa.string()), ("weight", pa.float64())]))
    names = list(GENERATED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, name in names:  # the driver's labels, in its order
            label_of_name(name)
        known: dict[str, tuple] = {}
        for batch in batches:
            made, errors = [], []
            for text in batch[column].to_pylist():
                if text not in known:
                    if len(known) > 100_000:
                        known.clear()
                    try:
                        got, error = ([], None) if text is None else (_found(text, rule, token_type, choice, n), None)
                        if text is not None and not got:
                            error = f"no output for {text!r}"
                    except (RewriteError, ValueError) as e:
                        got, error = [], str(e)
                    if strict and error:
                        raise RewriteError(error)
                    known[text] = [{"ostring": o, "weight": w} for o, w in got], error
                a, b = known[text]
                made.append(a)
                errors.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind), pa.array(errors, pa.string())], [*batch.schema.names, "candidates", "error"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("candidates", cell), T.StructField("error", T.StringType())]))


def rewrite(df: DataFrame, column: str, rule, to: str = "output", choice: str = "top", strict: bool = False, token_type: str | None = None) -> DataFrame:
    """df with the best output in `to`, null where there is none (or several, with choice `one`)."""
    made = candidates_of(df, column, rule, choice, 1, strict, token_type)
    return made.withColumn(to, F.try_element_at("candidates", F.lit(1))["ostring"]).drop("candidates", "error")


def exploded(df: DataFrame, column: str, rule, choice: str = "all", n: int = 1, token_type: str | None = None) -> DataFrame:
    """One row a candidate: df's columns, ostring, weight."""
    made = candidates_of(df, column, rule, choice, n, token_type=token_type)
    return made.select(*df.columns, F.inline("candidates"))


def register(spark: SparkSession, name: str, rule, choice: str = "all", n: int = 1, token_type: str | None = None) -> None:
    """A table function for SQL: SELECT * FROM t, LATERAL name(text), with columns ostring and weight."""
    from pyspark.sql.functions import udtf

    class Rewrites:
        def eval(self, text: str):
            if text is not None:
                yield from _found(text, rule, token_type, choice, n)

    spark.udtf.register(name, udtf(Rewrites, returnType="ostring string, weight double"))


def register_scalar(spark: SparkSession, name: str, rule, choice: str = "top", strict: bool = False, token_type: str | None = None) -> None:
    """A function for SQL: SELECT name(text), the best output; null where there is none (or several, with choice `one`), or an error if strict."""
    if choice not in ("top", "one"):
        raise ArgumentError(f"not a choice of one output: {choice}")
    names = list(GENERATED)

    def best(texts: pd.Series) -> pd.Series:
        for _, label in names:
            label_of_name(label)
        known: dict = {}
        for text in texts.unique():
            try:
                found = [] if text is None else _found(text, rule, token_type, choice, 1)
                if strict and text is not None and not found:
                    raise RewriteError(f"no output for {text!r}")
            except (RewriteError, ValueError):
                if strict:
                    raise
                found = []
            known[text] = found[0][0] if found else None
        return texts.map(known)

    spark.udf.register(name, F.pandas_udf(best, "string"))
