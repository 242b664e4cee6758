"""String files, symbol tables, parentheses and machine text as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..operators.pushdown import Parentheses
from ..operators.relation import Relation
from ..semiring import TROPICAL, Semiring, semiring


def cleaned(line: Column) -> Column:
    """A line without its comment: from an unescaped # to the end, with the space before it; \\# is #."""
    return F.regexp_replace(F.regexp_replace(line, r"(?<!\\)#.*$", ""), r"\\#", "#")


def string_file(spark: SparkSession, path: str, ring: Semiring | str = TROPICAL) -> Relation:
    """Lines of one to three fields, input[, output[, weight]], split at tabs; blank lines and comments are skipped.

    An empty field is the empty string.  More than three fields, or a weight that is no
    number, fail when the rows are read.
    """
    ring = semiring(ring)
    line = F.regexp_replace("value", r"\s*(?<!\\)#.*$", "")
    fields = F.split(F.replace(line, F.lit("\\#"), F.lit("#")), "\t", -1)
    rows = spark.read.text(path).select(fields.alias("f")).where("not (size(f) = 1 and trim(f[0]) = '')")
    weight = F.when(F.size("f") < 3, F.lit(ring.one)).otherwise(F.coalesce(F.expr("try_cast(f[2] as double)"), F.raise_error(F.concat(F.lit("not a weight: "), F.expr("get(f, 2)")))))
    istring = F.when(F.size("f") > 3, F.raise_error(F.lit("more than three fields"))).otherwise(F.expr("f[0]"))
    return Relation(rows.select(istring.alias("istring"), F.coalesce(F.expr("get(f, 1)"), F.expr("f[0]")).alias("ostring"), weight.alias("weight")), ring).merged()


def escape_field(c: Column) -> Column:
    """Brackets, backslashes and # escaped for a string file."""
    return F.regexp_replace(c, r"([\[\]\\#])", r"\\$1")


def field_text(text: str) -> str:
    out = text
    for c in "\\[]#":
        out = out.replace(c, "\\" + c)
    return out


def line_of(fields) -> str:
    """One line of a string file; one to three fields."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    if not 1 <= len(fields) <= 3:
        raise ArgumentError("a line has one to three fields")
    return "\t".join(map(str, fields))


def write_string_file(rows: DataFrame, path: str, escaped: bool = True) -> None:
    """A DataFrame of one to three columns as lines, in the order of its partitions."""
    if not 1 <= len(rows.columns) <= 3:
        raise ArgumentError("a line has one to three fields")
    fields = [escape_field(F.col(c)) if escaped and k < 2 else F.col(c).cast("string") for k, c in enumerate(rows.columns)]
    rows.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(id, symbol) from text lines symbol<TAB>id."""
    return spark.read.csv(path, sep="\t", schema="symbol string, id long", quote="").select("id", "symbol")


def write_symbols(symbols: DataFrame, path: str) -> None:
    symbols.orderBy("id").select(F.concat_ws("\t", "symbol", "id").alias("value")).write.text(path)


def read_parentheses(spark: SparkSession, path: str) -> Parentheses:
    """From lines push<TAB>pop[<TAB>stack]."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(f[0].cast("long").alias("push"), f[1].cast("long").alias("pop"), F.coalesce(F.get(f, F.lit(2)).cast("int"), F.lit(1)).alias("stack"))
    return Parentheses.of_frame(rows)


def write_parentheses(spark: SparkSession, parens: Parentheses, path: str) -> None:
    parens.frame(spark).select(F.concat_ws("\t", "push", "pop", "stack").alias("value")).write.text(path)


def read_arc_text(spark: SparkSession, path: str, acceptor: bool = False, ring: Semiring | str = TROPICAL):
    """An ArcTable from lines `src dst ilabel [olabel] [weight]` and `state [weight]`; the first line's state is the start."""
    from ..operators.arcs import ArcTable

    n = 3 if acceptor else 4
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("place", F.monotonically_increasing_id()).withColumn("f", F.split(F.trim("value"), r"\s+"))
    at = lambda k: F.get("f", F.lit(k))
    arcs = rows.where(F.size("f") >= n).select(at(0).cast("long").alias("src"), at(2).cast("long").alias("ilabel"), at(2 if acceptor else 3).cast("long").alias("olabel"), F.coalesce(at(n).cast("double"), F.lit(0.0)).alias("weight"), at(1).cast("long").alias("dst"))
    finals = rows.where(F.size("f") < n).groupBy(at(0).cast("long").alias("state")).agg(F.min(F.coalesce(at(1).cast("double"), F.lit(0.0))).alias("final_weight"))
    start = rows.agg(F.min_by(at(0).cast("long"), "place")).scalar()
    every = arcs.select(F.explode(F.array("src", "dst")).alias("state")).union(finals.select("state")).distinct()
    states = every.join(finals, "state", "left").select("state", (F.col("state") == start).alias("is_start"), "final_weight")
    return ArcTable(states, arcs, ring)


def write_arc_text(table, path: str) -> None:
    arcs = table.arcs.select(F.concat_ws("\t", "src", "dst", "ilabel", "olabel", "weight").alias("value"), (~F.col("src").isin(table.states.where("is_start").select("state").scalar())).alias("late"))
    finals = table.states.where("final_weight is not null").select(F.concat_ws("\t", "state", "final_weight").alias("value"), F.lit(True).alias("late"))
    arcs.unionByName(finals).repartition(1).sortWithinPartitions("late", "value").select("value").write.text(path)
