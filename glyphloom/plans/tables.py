"""Queries of algorithms on arc tables: products, classes, best and random paths, nesting; none brings a table to the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arc_classes as K
from ..operators import arc_paths as W
from ..operators import arc_product as X
from ..operators import arc_stack as S
from ..operators.arcs import ArcTable
from .queries import QUERIES, SQL, _graph, query, table

_GRAPH = """(SELECT 0::BIGINT AS src, r_regionkey::BIGINT + 1 AS label, r_regionkey::DOUBLE AS weight, r_regionkey::BIGINT + 1 AS dst FROM region
UNION ALL SELECT n_regionkey + 1, n_nationkey + 100, n_nationkey % 4, n_nationkey + 100 FROM nation UNION ALL SELECT 0, n_nationkey + 100, 3, n_nationkey + 100 FROM nation
UNION ALL SELECT c_nationkey + 100, c_custkey + 1000, c_custkey % 10, c_custkey + 1000 FROM customer)"""


def _chains_of(df, text, weight=None):
    """One chain of arcs a row from state 0: the strings of a column as a table that is not deterministic.  df has a number `k` from 1."""
    n = F.length(text)
    at = df.select("k", F.col(text).alias("text"), n.alias("n"), (F.lit(0.0) if weight is None else F.col(weight).cast("double")).alias("w"), F.explode(F.sequence(F.lit(1), n)).alias("p"))
    state = lambda p: F.when(p == 0, 0).otherwise(F.col("k") * 1000 + p).cast("long")
    label = F.ascii(F.substring("text", F.col("p"), F.lit(1))).cast("long")
    arcs = at.select(state(F.col("p") - 1).alias("src"), label.alias("ilabel"), label.alias("olabel"), F.when(F.col("p") == F.col("n"), F.col("w")).otherwise(0.0).alias("weight"), state(F.col("p")).alias("dst"))
    ends = df.select(state(n).alias("state"), F.lit(False).alias("is_start"), F.lit(0.0).alias("final_weight"))
    inner = at.where(F.col("p") < F.col("n")).select(state(F.col("p")).alias("state"), F.lit(False).alias("is_start"), F.lit(None).cast("double").alias("final_weight"))
    first = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("state"), F.lit(True).alias("is_start"), F.lit(None).cast("double").alias("final_weight"))
    return ArcTable(first.unionByName(inner).unionByName(ends), arcs)


def _brands(spark, sf_dir):
    """Each size and type of a part as a string of three, weighted by the least price."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.substring("p_type", 1, 1)).alias("code"), F.floor("p_retailprice").alias("price"))
    return p.groupBy("code").agg(F.min("price").alias("price")).select("code", "price", F.xxhash64("code").alias("h")).withColumn("k", F.pmod("h", F.lit(1 << 40)) + 1)


_CODES = "(SELECT lpad(p_size::VARCHAR, 2, '0') || left(p_type, 1) AS code, min(floor(p_retailprice))::DOUBLE AS price FROM part GROUP BY 1)"
_CHARS = lambda c: F.concat_ws("", F.transform(c, lambda x: F.char(x)))


@query(f"""
WITH p AS (SELECT DISTINCT left(code, k) AS head FROM (SELECT code, unnest(range(0, length(code) + 1)) AS k FROM {_CODES}))
SELECT length(head)::BIGINT AS depth, count(*)::BIGINT AS n_states FROM p GROUP BY 1""")
def arc_determinize(spark, sf_dir):
    """Chains of strings, determinized: a state for each beginning."""
    made = K.determinize(_chains_of(_brands(spark, sf_dir), "code"))
    return made.order().groupBy(F.col("level").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n_states"))


@query(f"""
WITH p AS (SELECT left(code, k) AS head, substr(code, k + 1) AS tail FROM (SELECT code, unnest(range(0, length(code) + 1)) AS k FROM {_CODES})),
s AS (SELECT head, string_agg(DISTINCT tail, ' ' ORDER BY tail) AS tails, max(length(tail)) AS height FROM p GROUP BY 1)
SELECT height::BIGINT AS height, count(DISTINCT tails)::BIGINT AS n_states FROM s GROUP BY 1""")
def arc_minimize(spark, sf_dir):
    """The least acceptor of all codes has a state for each set of endings."""
    made = K.minimize(K.determinize(_chains_of(_brands(spark, sf_dir), "code")))
    turned = ArcTable(made.states, made.arcs.select(F.col("dst").alias("src"), "ilabel", "olabel", "weight", F.col("src").alias("dst")))
    return turned.order().groupBy(F.col("level").cast("long").alias("height")).agg(F.count(F.lit(1)).alias("n_states"))


@query(f"SELECT code, price AS weight FROM {_CODES}")
def arc_determinize_weighted(spark, sf_dir):
    """Weights pushed towards the start while determinizing and minimizing; the strings keep them."""
    made = K.minimize(K.determinize(_chains_of(_brands(spark, sf_dir), "code", "price")))
    return made.paths().select(_CHARS(F.col("ilabels")).alias("code"), F.round("weight", 6).alias("weight"))


@query(f"SELECT row_number() OVER (ORDER BY price, code)::INTEGER AS rank, price AS weight FROM {_CODES} ORDER BY price LIMIT 12")
def arc_best_paths(spark, sf_dir):
    """The weights of the twelve cheapest codes, in order."""
    return W.best_paths(_chains_of(_brands(spark, sf_dir), "code", "price"), 12).select("rank", "weight")


@query("""
WITH p AS (SELECT c_custkey + 1000 AS customer, r_regionkey + n_nationkey % 4 + c_custkey % 10 + c_custkey / 1e5 AS w, 1 AS way FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey + 1000, 3 + c_custkey % 10 + c_custkey / 1e5, 2 FROM customer WHERE c_custkey % 2 = 0)
SELECT customer, round(w, 5) AS weight FROM (SELECT customer, min(w) AS w FROM p GROUP BY 1) ORDER BY w LIMIT 10""")
def arc_best_strings(spark, sf_dir):
    """The ten nearest customers by their cheapest way; what is read on the way does not count as different."""
    g = _graph(spark, sf_dir)
    last = F.col("dst") >= 1000
    arcs = g.arcs.select("src", F.when(last, F.col("ilabel")).otherwise(0).alias("ilabel"), F.when(last, F.col("olabel")).otherwise(0).alias("olabel"), (F.col("weight") + F.when(last, (F.col("dst") - 1000) / 1e5).otherwise(0.0)).alias("weight"), "dst")
    found = W.best_paths(ArcTable(g.states, arcs), 10, unique=True)
    return found.select(F.element_at("olabels", -1).alias("customer"), F.round("weight", 5).alias("weight"))


@query(f"""
WITH RECURSIVE g AS {_GRAPH},
c AS (SELECT src, label, weight, dst, md5(label || '/' || label || '/' || dst) AS k FROM g UNION ALL SELECT c_custkey + 1000, NULL, 0, NULL, md5('end/end/end') FROM customer WHERE c_custkey % 2 = 0),
live AS (SELECT c_custkey + 1000 AS s FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_nationkey + 100 FROM customer WHERE c_custkey % 2 = 0 UNION SELECT n_regionkey + 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0),
w AS (SELECT * FROM c WHERE dst IS NULL OR dst IN (SELECT s FROM live)),
cum AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY k) - 1)::DOUBLE / count(*) OVER (PARTITION BY src) AS low, row_number() OVER (PARTITION BY src ORDER BY k)::DOUBLE / count(*) OVER (PARTITION BY src) AS high FROM w),
walk AS (SELECT i AS sample, 0 AS step, 0::BIGINT AS state, []::BIGINT[] AS path FROM range(500) t(i)
UNION ALL SELECT sample, step + 1, dst, list_append(path, dst) FROM walk JOIN cum ON src = state AND dst IS NOT NULL AND ('0x' || substr(md5('7/' || sample || '/' || step), 1, 13))::BIGINT / 4503599627370496.0 >= low AND ('0x' || substr(md5('7/' || sample || '/' || step), 1, 13))::BIGINT / 4503599627370496.0 < high)
SELECT sample, path[-1] AS customer, len(path)::INTEGER AS n_arcs FROM walk WHERE state >= 1000""")
def arc_random_paths(spark, sf_dir):
    """Five hundred ways to customers; every draw is a digest of the seed, the sample and the step, in SQL as here."""
    found = W.random_paths(_graph(spark, sf_dir), 500, seed=7)
    return found.select("sample", F.element_at("olabels", -1).alias("customer"), F.size("olabels").alias("n_arcs"))


# ---------------------------------------------------------------- products


def _steps(spark, sf_dir):
    """What a way may look like: a label of a region is silent, one of a nation keeps its remainder by 3, one of a customer its remainder by 5."""
    g = _graph(spark, sf_dir)
    labels = g.arcs.select("olabel").distinct()
    kind = F.when(F.col("olabel") < 100, 0).when(F.col("olabel") < 1000, F.col("olabel") % 3 + 1).otherwise(F.col("olabel") % 5 + 11).cast("long")
    loops = labels.select(F.lit(0).cast("long").alias("src"), F.col("olabel").alias("ilabel"), kind.alias("olabel"), F.lit(0.5).alias("weight"), F.lit(0).cast("long").alias("dst"))
    state = spark.range(1).select(F.col("id").alias("state"), F.lit(True).alias("is_start"), F.lit(0.0).alias("final_weight"))
    return ArcTable(state, loops)


@query(f"""
WITH g AS {_GRAPH}, k AS (SELECT *, CASE WHEN label < 100 THEN 0 WHEN label < 1000 THEN label % 3 + 1 ELSE label % 5 + 11 END AS kind FROM g)
SELECT src, dst, label AS ilabel, kind::BIGINT AS olabel, weight + 0.5 AS weight FROM k""")
def arc_compose(spark, sf_dir):
    """The graph followed by kinds of its labels: all arcs that are reached."""
    g = _graph(spark, sf_dir)
    made, pairs = X.compose_pairs(g, _steps(spark, sf_dir))
    name = lambda c: pairs.select(F.col("state").alias(c), F.col("left").alias(f"{c}_was"))
    arcs = made.arcs.join(name("src"), "src").join(name("dst"), "dst")
    return arcs.select(F.col("src_was").alias("src"), F.col("dst_was").alias("dst"), "ilabel", "olabel", "weight")


@query("""
WITH a AS (SELECT n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0)
SELECT f AS filter, n_regionkey::BIGINT + 1 AS region, c_custkey + 1000 AS customer, count(*)::BIGINT AS n FROM a, (SELECT unnest(['match', 'sequence']) AS f) GROUP BY 1, 2, 3""")
def arc_compose_filters(spark, sf_dir):
    """Silent moves on both sides: each pair of ways once, whatever the order.

    On the left nations are written silently; on the right a silent move may come first.
    """
    g = _graph(spark, sf_dir)
    by_region = g.arcs.where("not (src = 0 and dst between 100 and 999)")
    left = ArcTable(g.states, by_region.select("src", "ilabel", F.when(F.col("olabel").between(100, 999), 0).otherwise(F.col("olabel")).alias("olabel"), "weight", "dst"))
    zero = F.lit(0).cast("long")
    row = lambda df, src, i, o, dst: df.select(F.lit(src).cast("long").alias("src"), i.alias("ilabel"), o.alias("olabel"), F.lit(0.0).alias("weight"), F.lit(dst).cast("long").alias("dst"))
    label = F.col("olabel")
    out = g.arcs.select("olabel").distinct()
    right = row(out.where(label < 100), 0, label, label, 1).unionByName(row(spark.range(1), 1, zero, zero, 2)).unionByName(row(out.where(label >= 1000), 2, label, label, 3))
    states = spark.range(4).select(F.col("id").alias("state"), (F.col("id") == 0).alias("is_start"), F.when(F.col("id") == 3, 0.0).alias("final_weight"))
    found = None
    for name in ("match", "sequence"):
        p = X.compose(left, ArcTable(states, right), name, connect=False).paths()
        one = p.groupBy(F.lit(name).alias("filter"), F.element_at("olabels", 1).alias("region"), F.element_at("olabels", 2).alias("customer")).agg(F.count(F.lit(1)).alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


@query(f"SELECT code FROM {_CODES} WHERE code NOT LIKE '1%'")
def arc_difference(spark, sf_dir):
    """Codes without those that begin with 1."""
    every = _brands(spark, sf_dir)
    made = X.difference(_chains_of(every, "code"), K.determinize(_chains_of(every.where("code like '1%'"), "code")), connect=False)
    return made.paths().select(_CHARS(F.col("ilabels")).alias("code"))


@query(f"SELECT code, price + 1 AS weight FROM {_CODES} WHERE code LIKE '%S'")
def arc_intersect(spark, sf_dir):
    """Codes that end in S, with the weights of both sides."""
    every = _brands(spark, sf_dir)
    fives = every.where("code like '%S'").withColumn("one", F.lit(1))
    made = X.intersect(_chains_of(every, "code", "price"), K.determinize(_chains_of(fives, "code", "one")), connect=False)
    return made.paths().select(_CHARS(F.col("ilabels")).alias("code"), "weight")


# ---------------------------------------------------------------- comparison


@query(f"SELECT min(code) AS code, arg_min(price, code) AS weight_a, arg_min(price, code) + 1 AS weight_b FROM (SELECT * FROM {_CODES} WHERE length(code) = (SELECT min(length(code)) FROM {_CODES} WHERE code LIKE '%E') AND code LIKE '%E')")
def arc_counterexample(spark, sf_dir):
    """A shortest code that two tables weigh differently: those that end in E cost one more."""
    every = _brands(spark, sf_dir)
    other = every.withColumn("price", F.col("price") + F.when(F.col("code").endswith("E"), 1).otherwise(0))
    a, b = (K.determinize(_chains_of(x, "code", "price")) for x in (every, other))
    return K.counterexample(a, b).select(_CHARS(F.col("labels")).alias("code"), F.round("weight_a", 6).alias("weight_a"), F.round("weight_b", 6).alias("weight_b"))


@query(f"SELECT length(head)::BIGINT AS depth, count(*)::BIGINT AS n_same FROM (SELECT DISTINCT left(code, k) AS head FROM (SELECT code, unnest(range(0, length(code) + 1)) AS k FROM {_CODES})) GROUP BY 1")
def arc_renumbering(spark, sf_dir):
    """Codes in another order give other numbers of states only."""
    every = _brands(spark, sf_dir)
    a, b = (K.determinize(_chains_of(x, "code")) for x in (every, every.withColumn("k", F.lit(1 << 41) - F.col("k"))))
    same = K.renumbering(a, b)
    return a.order().join(same, "state").join(b.order().select(F.col("state").alias("other"), F.col("level").alias("l2")), "other").where("level = l2").groupBy(F.col("level").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n_same"))


# ---------------------------------------------------------------- weights


@query(f"""
WITH b AS (SELECT 0::BIGINT AS s, min(w) AS d FROM (SELECT r_regionkey + n_nationkey % 4 + c_custkey % 10 AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0 UNION ALL SELECT 3 + c_custkey % 10 FROM customer WHERE c_custkey % 2 = 0)
UNION ALL SELECT n_regionkey + 1, min(n_nationkey % 4 + c_custkey % 10) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 GROUP BY 1
UNION ALL SELECT c_nationkey + 100, min(c_custkey % 10) FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT c_custkey + 1000, 0 FROM customer WHERE c_custkey % 2 = 0)
SELECT src, dst, (weight + coalesce(y.d - x.d, 0) + CASE WHEN src = 0 THEN x.d ELSE 0 END)::DOUBLE AS weight FROM {_GRAPH} LEFT JOIN b x ON x.s = src LEFT JOIN b y ON y.s = dst""")
def arc_push(spark, sf_dir):
    """Weights pushed to the start, which keeps the total: arcs as they are then."""
    return _graph(spark, sf_dir).push().arcs.select("src", "dst", "weight")


@query("""
SELECT c_custkey + 1000 AS customer, (r_regionkey + n_nationkey % 4 + c_custkey % 10)::DOUBLE AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey + 1000, (3 + c_custkey % 10)::DOUBLE FROM customer WHERE c_custkey % 2 = 0""")
def arc_push_paths(spark, sf_dir):
    """Pushed to the finals, with log weights, all paths weigh what they did."""
    g = _graph(spark, sf_dir)
    p = ArcTable(g.states, g.arcs, "log").push(to_final=True).paths()
    return p.select(F.element_at("olabels", -1).alias("customer"), F.round("weight", 5).alias("weight"))


@query("SELECT k::BIGINT AS state, round(power(0.125, k) / (1 - power(0.125, 5)), 6) AS mass FROM (SELECT DISTINCT n_nationkey % 5 AS k FROM nation)")
def arc_log_cycle(spark, sf_dir):
    """Mass that goes round a ring of five and an eighth of which is left after each step: as nations of one remainder point to the next."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("src")).distinct()
    arcs = n.select("src", F.lit(1).cast("long").alias("ilabel"), F.lit(1).cast("long").alias("olabel"), F.lit(2.0794415416798357).alias("weight"), ((F.col("src") + 1) % 5).alias("dst"))
    states = n.select(F.col("src").alias("state"), (F.col("src") == 0).alias("is_start"), F.when(F.col("src") == 4, 0.0).alias("final_weight"))
    found = ArcTable(states, arcs, "log").shortestdistance()
    return found.select("state", F.round(F.exp(-F.col("distance")), 6).alias("mass"))


# ---------------------------------------------------------------- nesting

PUSH, POP = 1_000_001, 1_000_002


def _nested(spark, sf_dir):
    """For each order a way in and out of its customer, below the customer's nation: marks of a customer are its own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("price"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    row = lambda df, src, label, w, dst: df.select(src.cast("long").alias("src"), label.cast("long").alias("ilabel"), label.cast("long").alias("olabel"), w.cast("double").alias("weight"), dst.cast("long").alias("dst"))
    k, nation, cust, big = F.col("c_custkey"), F.col("c_nationkey"), F.col("o_custkey"), 10_000_000
    mark = lambda key, side: 100 + 2 * key + side
    arcs = [
        row(c.select("c_nationkey").distinct(), F.lit(0), mark(F.lit(big) + nation, 0), nation, 1 + nation),
        row(c, 1 + nation, mark(k, 0), k % 7, 1000 + 2 * k),
        row(o, 1000 + 2 * cust, F.lit(7), F.col("price"), 1001 + 2 * cust),
        # any customer's mark may be tried on the way out; only its own fits
        row(c, 1001 + 2 * k, mark(k, 1), F.lit(1), 101 + nation),
        row(c.where(k > 0), 1001 + 2 * k, mark(k - 1, 1), F.lit(0), 101 + nation),
        row(c.select("c_nationkey").distinct(), 101 + nation, mark(F.lit(big) + nation, 1), F.lit(2), F.lit(500) + nation),
    ]
    all_of = arcs[0]
    for more in arcs[1:]:
        all_of = all_of.unionByName(more)
    states = all_of.select(F.explode(F.array("src", "dst")).alias("state")).distinct()
    final = F.when(F.col("state").between(500, 999), 0.0)
    parens = c.select(mark(k, 0).alias("push"), mark(k, 1).alias("pop")).union(c.select(mark(F.lit(big) + nation, 0), mark(F.lit(big) + nation, 1)).distinct())
    return ArcTable(states.select("state", (F.col("state") == 0).alias("is_start"), final.alias("final_weight")), all_of), parens


@query("""
WITH o AS (SELECT o_custkey AS k, min(floor(o_totalprice))::DOUBLE AS price FROM orders GROUP BY 1)
SELECT 500 + c_nationkey::BIGINT AS state, min(c_nationkey + c_custkey % 7 + price + 3)::DOUBLE AS weight FROM customer JOIN o ON k = c_custkey GROUP BY 1""")
def arc_balanced_shortest(spark, sf_dir):
    """The cheapest balanced way through each nation: into a nation, a customer, an order, and out by the same marks."""
    return S.balanced_shortest(*_nested(spark, sf_dir))


@query("""
WITH o AS (SELECT o_custkey AS k, min(floor(o_totalprice))::DOUBLE AS price FROM orders GROUP BY 1),
e AS (SELECT c_custkey AS c, c_nationkey AS n, price FROM customer JOIN o ON k = c_custkey)
SELECT 1000 + 2 * c AS entry, 1001 + 2 * c AS state, price AS distance FROM e
UNION ALL SELECT 1 + n::BIGINT, 101 + n::BIGINT, min(c % 7 + price + 1) FROM e GROUP BY n""")
def arc_balanced(spark, sf_dir):
    """Least weights of balanced stretches inside customers and nations."""
    found = S.balanced(*_nested(spark, sf_dir))
    return found.where("entry <> state and entry <> 0")


@query(f"SELECT 'a ' || x.code || ' of ' || y.code AS said FROM (SELECT code FROM {_CODES} WHERE code LIKE '5%') x, (SELECT code FROM {_CODES} WHERE code LIKE '5%') y")
def arc_replace(spark, sf_dir):
    """A grammar that calls a table of codes twice, expanded."""
    noun = 2_000_000
    text = [*map(ord, "a "), noun, *map(ord, " of "), noun]
    at = spark.range(len(text)).select(F.col("id").alias("src"), F.array(*map(F.lit, text))[F.col("id").cast("int")].cast("long").alias("ilabel"), (F.col("id") + 1).alias("dst"))
    root = ArcTable(spark.range(len(text) + 1).select(F.col("id").alias("state"), (F.col("id") == 0).alias("is_start"), F.when(F.col("id") == len(text), 0.0).alias("final_weight")), at.select("src", "ilabel", F.col("ilabel").alias("olabel"), F.lit(0.0).alias("weight"), "dst"))
    codes = K.minimize(K.determinize(_chains_of(_brands(spark, sf_dir).where("code like '5%'"), "code")))
    made, parens = S.replace(root, {noun: codes})
    return S.expand(made, parens).paths().select(_CHARS(F.col("ilabels")).alias("said"))


__all__ = ["QUERIES", "SQL"]
