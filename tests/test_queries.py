"""Every query of the plain library against its SQL, on the smallest tables."""

import os

import pytest
from compare import connection, difference

import __spark_entry__
from glyphloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"

#: Many rounds over few rows take up to a minute each; tests/compare.py runs them, tests/test_arc_*.py test their operators.
LONG = """arc_determinize arc_minimize arc_determinize_weighted arc_best_paths arc_best_strings arc_compose_filters arc_difference arc_intersect
arc_counterexample arc_renumbering arc_balanced arc_balanced_shortest arc_replace""".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", [name for name in SQL if name not in LONG])
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), connection(SF), SQL[name]) is None


def test_entry():
    assert set(SQL) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(monkeypatch):
    import builtins

    real = builtins.__import__

    def gone(name, *rest, **more):
        if name == "corpus_pipeline" or name.startswith("glyphloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *rest, **more)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert set(__spark_entry__.queries()) == set(QUERIES)
