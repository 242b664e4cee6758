"""Rules against their definition by enumeration, and against each other's physical forms."""

import random
from itertools import product

import pytest

from glyphloom.errors import ArgumentError, RewriteError
from glyphloom.functions import native
from glyphloom.operators import rules as R
from glyphloom.operators.apply import candidates_of, exploded, register, rewrite
from glyphloom.operators.machine import accep, closure, concat, cross, machine, string_map, union
from glyphloom.plans.choose import LiteralRule, apply_rules

AB = closure(union("a", "b", "c"))


def enumerate_rule(x, sites_of, fits, direction, mode):
    """All outputs by choosing at each place: copy, or a site."""
    out = set()
    n = len(x)

    def walk(i, made, inserted):
        here = [(j, o) for j, o in sites_of(i) if not (j == i and inserted) and fits(i, j, made)]
        blocked = mode == "obl" and any(True for j, o in sites_of(i) if fits(i, j, made)) and not inserted
        for j, o in here:
            walk(j, made + o, j == i)
        if not blocked:
            if i == n:
                out.add(made)
            else:
                walk(i + 1, made + x[i], False)

    walk(0, "", False)
    return out


def brute(x, tau, left, right, direction, mode):
    """tau: list of (phi, psi); contexts: lists of texts."""
    if direction == "rtl":
        flip = lambda s: s[::-1]
        made = brute(flip(x), [(flip(a), flip(b)) for a, b in tau], [flip(r) for r in right], [flip(c) for c in left], "ltr", mode)
        return {flip(m) for m in made}
    sites = lambda i: [(i + len(a), b) for a, b in tau if x.startswith(a, i)]

    def fits(i, j, made):
        before = made if direction == "ltr" else x[:i]
        return any(before.endswith(c) for c in left) and any(x[j:].startswith(r) for r in right)

    return enumerate_rule(x, sites, fits, direction, mode)


@pytest.mark.parametrize("direction,want", [("ltr", "ababba"), ("rtl", "abbaba"), ("sim", "abaaba")])
def test_directions(spark, direction, want):
    rule = R.cdrewrite(cross("b", "a"), "b", "b", AB, direction)
    assert R.one_top_rewrite("abbbba", rule) == want
    df = spark.createDataFrame([("abbbba",), ("",), (None,), ("b",), ("bbb",)], "s string")
    rows = df.select("s", native.literal_rule(df.s, "b", "a", "b", "b", direction).alias("o")).collect()
    assert rows[0].o == want and rows[2].o is None
    assert all(r.o == R.one_top_rewrite(r.s, rule) for r in rows if r.s is not None)


@pytest.mark.parametrize("direction", R.DIRECTIONS)
@pytest.mark.parametrize("mode", R.MODES)
def test_against_enumeration(direction, mode):
    rnd = random.Random(f"{direction}{mode}")
    word = lambda low, high: "".join(rnd.choice("ab") for _ in range(rnd.randrange(low, high)))
    for _ in range(60):
        tau = list({word(0 if rnd.random() < 0.2 else 1, 3): word(0, 3) for _ in range(rnd.randrange(1, 3))}.items())
        left, right = [word(0, 2) for _ in range(rnd.randrange(1, 3))], [word(0, 2) for _ in range(rnd.randrange(1, 3))]
        rule = R.cdrewrite(string_map(tau), union(*map(accep, left)) if len(left) > 1 else left[0], union(*map(accep, right)) if len(right) > 1 else right[0], AB, direction, mode)
        for x in map("".join, product("ab", repeat=rnd.randrange(0, 5))):
            got = {o for o, _ in rule.candidates(x)}
            assert got == brute(x, tau, left, right, direction, mode), (tau, left, right, x)


def test_native_equals_kernel(spark):
    rnd, cases = random.Random(2), []
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for k in range(8):
        phi = rnd.choice(["a", "b", "ab", "abc"])
        cases.append(LiteralRule(phi, rnd.choice(["", "b", "aa", "$1"]), rnd.choice(["", "a", "bc", "[BOS]", "[BOS]b"]), rnd.choice(["", "b", "[EOS]", "c[EOS]"]), rnd.choice(R.DIRECTIONS)))
    made = df
    for k, c in enumerate(cases):
        made = made.withColumn(f"o{k}", native.literal_rule(made.s, c.phi, c.psi, c.left, c.right, c.direction))
    compiled = [c.compiled(closure(union(*"abc$1"))) for c in cases]
    for row in made.collect():
        for k, rule in enumerate(compiled):
            assert [o for o, _ in rule.candidates(row.s)] == [row[f"o{k}"]], (cases[k], row.s)
    with pytest.raises(ArgumentError):
        native.literal_rule(df.s, "aa", "b")


def test_optional_weights_and_ranks():
    rule = R.cdrewrite(string_map([("t", ""), ("d", "")]), "", "[EOS]", closure(union(*"abcdefist")), mode="opt")
    assert R.rewrites("fist", rule) == ["fis", "fist"] and R.matches("fist", "fis", rule)
    with pytest.raises(RewriteError, match="fis.*fist"):
        R.one_top_rewrite("fist", rule)
    cheap = R.cdrewrite(string_map([("a", "x", 2.0), ("a", "y", 1.0), ("b", "z", -1.0)]), "", "", closure(union(*"ab")))
    assert cheap.candidates("ab") == [("yz", 0.0), ("xz", 1.0)]
    assert R.top_rewrites("aa", cheap, 2) == ["yy", "xy"] and R.optimal_rewrites("aa", cheap) == ["yy"] and R.top_rewrite("aa", cheap) == "yy"
    with pytest.raises(RewriteError):
        R.rewrites("q", cheap)


def test_ambiguous_sites_give_every_reading():
    rule = R.cdrewrite(string_map([("a", "1"), ("aa", "2")]), "", "", AB)
    assert set(R.rewrites("aab", rule)) == {"11b", "2b"}


def test_preconditions():
    for bad in (cross("a", "b"), accep("a", weight=1)):
        with pytest.raises(ArgumentError):
            R.cdrewrite(cross("a", "b"), bad, "", AB)
        with pytest.raises(ArgumentError):
            R.cdrewrite(cross("a", "b"), "", "", bad)
    for kind in ({"direction": "up"}, {"mode": "maybe"}):
        with pytest.raises(ArgumentError):
            R.cdrewrite(cross("a", "b"), "", "", AB, **kind)


def test_columns(spark):
    rule = R.cdrewrite(string_map([("a", "x", 1), ("a", "y", 2)]), "", "", closure(union(*"ab")))
    df = spark.createDataFrame([(1, "ab"), (2, "q"), (3, None), (4, "")], "k int, s string")
    rows = {r.k: r for r in candidates_of(df, "s", rule).collect()}
    assert [tuple(c) for c in rows[1].candidates] == [("xb", 1.0), ("yb", 2.0)] and "no output" in rows[2].error and rows[3].error is None and rows[4].candidates[0].ostring == ""
    assert [(r.k, r.output) for r in rewrite(df, "s", rule).orderBy("k").collect()] == [(1, "xb"), (2, None), (3, None), (4, "")]
    assert exploded(df, "s", rule).count() == 3
    df.createOrReplaceTempView("texts")
    register(spark, "rewrites_of", rule)
    assert spark.sql("select k, ostring from texts, lateral rewrites_of(s)").count() == 3
    with pytest.raises(Exception, match="no output"):
        rewrite(df, "s", rule, strict=True).collect()


def test_chosen_plan(spark):
    df = spark.createDataFrame([("abab",)], "s string")
    rules = [LiteralRule("a", "b", "", "b"), LiteralRule("b", "", "", "[EOS]", "sim"), LiteralRule("bb", "c", direction="ltr")]
    got = apply_rules(df, "s", rules, "o", closure(union(*"abc")))
    assert got.collect()[0].o == "cb"
    plan = apply_rules(df, "s", rules[:2], "o")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_cascade():
    archive = {"one": R.cdrewrite(cross("a", "b"), "", "", AB), "two": machine(closure(union(cross("b", "c"), "a", "c"))), "three": R.cdrewrite(cross("c", "a"), "[BOS]", "", AB)}
    c = R.RuleCascade(archive)
    with pytest.raises(ArgumentError):
        c.rewrites("a")
    with pytest.raises(ArgumentError):
        c.set_rules(["none"])
    c.set_rules(["one", "two", "three"])
    assert c.one_top_rewrite("ab") == "ac" and c.matches("ab", "ac") and c.rewrites("ab") == ["ac"] and c.top_rewrites("ab", 1) == ["ac"] and c.optimal_rewrites("ab") == ["ac"] and c.top_rewrite("ab") == "ac"


def test_long_outputs_and_endless_ones():
    sigma = closure(union(*"abc"))
    for n in (70, 1000):
        assert R.cdrewrite(cross("a", "b" * n), "", "", sigma).candidates("a") == [("b" * n, 0.0)]
    assert R.rewrites("c", concat(cross("c", "d" * 900), cross("", "e"))) == ["d" * 900 + "e"]
    endless = R.cdrewrite(concat(cross("a", "b"), closure(cross("", "c"), 0, 0)), "", "", sigma)
    with pytest.raises(RewriteError):
        R.rewrites("a", endless)
    assert endless.candidates("b") == [("b", 0.0)]
    with pytest.raises(RewriteError):
        R.rewrites("a", concat("a", closure(cross("", "c"))))
