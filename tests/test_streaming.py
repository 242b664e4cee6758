from glyphloom.operators.machine import closure, cross, union
from glyphloom.operators.rules import cdrewrite
from glyphloom.plans.choose import LiteralRule
from glyphloom.streaming.rewrite import counts_by_window, rewrite_stream


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "abb"), ("2024-01-01 00:01:00", "b"), ("2024-01-01 01:00:00", "b")], "t string, s string").selectExpr("timestamp(t) t", "s")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    native = rewrite_stream(stream, "s", [LiteralRule("b", "c", "", "[EOS]")])
    compiled = rewrite_stream(native, "output", cdrewrite(cross("a", "d"), "", "", closure(union(*"abc"))), "out")
    counted = counts_by_window(compiled, "t", "out")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.out, r.n) for r in spark.table("counted").collect()) == [("c", 1), ("c", 1), ("dbc", 1)]
