import pytest

from glyphloom.errors import ArgumentError, StorageError
from glyphloom.operators import machine as M
from glyphloom.operators.arcs import ArcTable
from glyphloom.operators.pushdown import Parentheses
from glyphloom.operators.rules import RuleCascade
from glyphloom.sources import archive as A
from glyphloom.sources import lexicons as L


def test_string_file(spark, tmp_path):
    (tmp_path / "map.tsv").write_text("a\tb\t2\n# all comment\n\nx\\#y\tz  # why\nempty\t\na\tb\t1\nalone\n")
    rel = L.string_file(spark, str(tmp_path / "map.tsv"))
    assert {(i, o): w for i, o, w in rel.items()} == {("a", "b"): 1.0, ("x#y", "z"): 0.0, ("empty", ""): 0.0, ("alone", "alone"): 0.0}
    (tmp_path / "bad.tsv").write_text("a\tb\theavy\n")
    with pytest.raises(Exception, match="not a weight"):
        list(L.string_file(spark, str(tmp_path / "bad.tsv")).items())
    (tmp_path / "wide.tsv").write_text("a\tb\t1\tc\n")
    with pytest.raises(Exception, match="three fields"):
        list(L.string_file(spark, str(tmp_path / "wide.tsv")).items())
    df = spark.createDataFrame([("a#[", "b", 1)], "i string, o string, w int")
    L.write_string_file(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a\\#\\[\tb\t1"]
    assert L.line_of(["a", "b", 1]) == "a\tb\t1" and L.field_text("a[#") == "a\\[\\#"
    with pytest.raises(ArgumentError):
        L.line_of([])


def test_other_tables(spark, tmp_path):
    symbols = spark.createDataFrame([(1, "dog"), (0, "<eps>")], "id long, symbol string")
    L.write_symbols(symbols, str(tmp_path / "s"))
    assert {tuple(r) for r in L.read_symbols(spark, str(tmp_path / "s")).collect()} == {(0, "<eps>"), (1, "dog")}
    parens = Parentheses([(1, 2, 1), (3, 4, 2)])
    L.write_parentheses(spark, parens, str(tmp_path / "p"))
    assert list(L.read_parentheses(spark, str(tmp_path / "p"))) == list(parens)
    t = ArcTable.of_machine(spark, M.string_map([("ab", "c", 2.5), ("b", "d")]))
    L.write_arc_text(t, str(tmp_path / "m"))
    back = L.read_arc_text(spark, str(tmp_path / "m"))
    assert sorted(M.items(back.to_machine())) == sorted(M.items(t.to_machine()))


def test_archive(spark, tmp_path):
    path = str(tmp_path / "far")
    with A.Exporter(spark, path) as out:
        out["b"] = M.cross("b", "[ROLE]")
        out["a"] = "text"
        with pytest.raises(ArgumentError):
            out["a"] = "again"
        with pytest.raises(ArgumentError):
            out["c"] = M.accep("x", arc_type="log")
        with pytest.raises(ArgumentError):
            out.keys()
    far = A.Archive(spark, path)
    assert far.keys() == ["a", "b"] and far.find("aa") == "b" and "a" in far and "q" not in far and [k for k, _ in far] == ["a", "b"]
    assert far["a"].string() == "text" and far["b"].string() == "[ROLE]" and far.far_type == "default" and not far.closed
    with pytest.raises(KeyError):
        far["q"]
    c = RuleCascade(far)
    c.set_rules(["b"])
    assert c.one_top_rewrite("b") == "[ROLE]"
    for bad in (lambda: A.Archive(spark, path, "x"), lambda: A.Archive(spark, path, kind="zip")):
        with pytest.raises(ArgumentError):
            bad()
    with pytest.raises(StorageError):
        A.Archive(spark, str(tmp_path / "none"))
    A.run(lambda e: e.add("k", "v"), ["--output", str(tmp_path / "one")])
    A.run(lambda e: [e["x"].add("k", "1"), e["y"].add("k", "2")], ["--output", f"x={tmp_path}/x,y={tmp_path}/y"])
    assert A.Archive(spark, str(tmp_path / "one"))["k"].string() == "v" and A.Archive(spark, f"{tmp_path}/y")["k"].string() == "2"
