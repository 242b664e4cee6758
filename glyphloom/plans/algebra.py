"""More queries: weight maps, arc tables, machines made of a table's words, pushdown machines and grammars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..grammars import chat, dates, g2p, plurals
from ..operators import machine as M
from ..operators import pushdown as P
from ..operators.apply import exploded, register_scalar
from ..operators.arcs import ArcTable
from ..operators.morphology import Category, Feature
from ..operators.relation import Relation
from ..operators.rules import cdrewrite, lattice_to_dfa, lattice_to_nshortest, lattice_to_one_top_string, lattice_to_strings, rewrite_lattice
from .queries import QUERIES, SQL, _graph, _words, query, table

# ---------------------------------------------------------------- weight maps

_MAPS = {
    "invert": ({}, "-w"), "plus": ({"weight": 7.0}, "least(w, 7)"), "times": ({"weight": 2.5}, "w + 2.5"), "power": ({"power": 3}, "w * 3"),
    "quantize": ({"delta": 0.5}, "floor(w / 0.5 + 0.5) * 0.5"), "rmweight": ({}, "0"), "identity": ({}, "w"),
}


def _weighted(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return Relation(p.select(F.col("p_name").alias("istring"), F.col("p_brand").alias("ostring"), (F.col("p_size") / 4).alias("weight"))).merged()


def _map_query(kind, how):
    def run(spark, sf_dir):
        return _weighted(spark, sf_dir).weights(kind, **how).df

    run.__name__ = f"arcmap_{kind}"
    return run


for _kind, (_how, _sql) in _MAPS.items():
    query(f"SELECT p_name AS istring, p_brand AS ostring, ({_sql})::DOUBLE AS weight FROM (SELECT p_name, p_brand, min(p_size) / 4.0 AS w FROM part GROUP BY 1, 2)")(_map_query(_kind, _how))


# ---------------------------------------------------------------- arc tables

_ARCS = """(SELECT 0::BIGINT AS src, r_regionkey::BIGINT + 1 AS label, r_regionkey::DOUBLE AS weight, r_regionkey::BIGINT + 1 AS dst FROM region
UNION ALL SELECT n_regionkey + 1, n_nationkey + 100, n_nationkey % 4, n_nationkey + 100 FROM nation UNION ALL SELECT 0, n_nationkey + 100, 3, n_nationkey + 100 FROM nation
UNION ALL SELECT c_nationkey + 100, c_custkey + 1000, c_custkey % 10, c_custkey + 1000 FROM customer)"""


def _events(spark, sf_dir):
    """Parallel arcs between few states."""
    e = table(spark, sf_dir, "events")
    label = F.length("event_type").cast("long")
    arcs = e.select((F.col("user_id") % 20).alias("src"), label.alias("ilabel"), label.alias("olabel"), F.floor("value").cast("double").alias("weight"), (F.col("user_id") % 7 + 100).alias("dst"))
    states = arcs.select(F.explode(F.array("src", "dst")).alias("state")).distinct()
    return ArcTable(states.select("state", (F.col("state") == 0).alias("is_start"), F.when(F.col("state") >= 100, 0.0).alias("final_weight")), arcs)


_PARALLEL = "(SELECT user_id % 20 AS src, length(event_type)::BIGINT AS label, floor(value)::DOUBLE AS weight, user_id % 7 + 100 AS dst FROM events)"


@query(f"SELECT src, label AS ilabel, dst, min(weight) AS weight FROM {_PARALLEL} GROUP BY 1, 2, 3")
def statemap_arc_sum(spark, sf_dir):
    return _events(spark, sf_dir).arc_sum().arcs.select("src", "ilabel", "dst", "weight")


@query(f"SELECT DISTINCT src, label AS ilabel, dst, weight FROM {_PARALLEL}")
def statemap_arc_unique(spark, sf_dir):
    return _events(spark, sf_dir).arc_unique().arcs.select("src", "ilabel", "dst", "weight")


@query(f"""
WITH p AS (SELECT *, min(weight) OVER (PARTITION BY src, label, dst) AS low FROM {_PARALLEL})
SELECT src, label AS ilabel, dst, round(low - ln(sum(exp(low - weight))), 6) AS weight FROM p GROUP BY src, label, dst, low""")
def arc_sum_log(spark, sf_dir):
    """Parallel arcs added as probabilities."""
    x = _events(spark, sf_dir)
    found = ArcTable(x.states, x.arcs, "log").arc_sum()
    return found.arcs.select("src", "ilabel", "dst", F.round("weight", 6).alias("weight"))


@query(f"SELECT src, label AS ilabel, label AS olabel, weight, dst FROM {_ARCS}")
def arc_encode_decode(spark, sf_dir):
    coded, codes = _graph(spark, sf_dir).encode(labels=True, weights=True)
    return coded.decode(codes).arcs


@query(f"SELECT count(DISTINCT label)::BIGINT AS n_codes FROM {_ARCS}")
def arc_encode_labels(spark, sf_dir):
    return _graph(spark, sf_dir).encode(labels=True)[1].agg(F.count(F.lit(1)).alias("n_codes"))


@query(f"SELECT src, dst, weight + dst % 7 - src % 7 AS weight FROM {_ARCS}")
def arc_reweight(spark, sf_dir):
    g = _graph(spark, sf_dir)
    potentials = g.states.select("state", (F.col("state") % 7).cast("double").alias("distance"))
    return g.reweight(potentials).arcs.select("src", "dst", "weight")


@query("SELECT c_custkey + 1000 AS src, -2::BIGINT AS dst FROM customer WHERE c_custkey % 2 = 0")
def arc_superfinal(spark, sf_dir):
    return _graph(spark, sf_dir).superfinal().arcs.where("dst = -2").select("src", "dst")


@query(f"SELECT dst AS src, label AS ilabel, src AS dst FROM {_ARCS} UNION ALL SELECT -1, 0, c_custkey + 1000 FROM customer WHERE c_custkey % 2 = 0")
def arc_reverse(spark, sf_dir):
    return _graph(spark, sf_dir).reverse().arcs.select("src", "ilabel", "dst")


@query(f"SELECT src, label * 2 AS ilabel, label * 2 AS olabel, dst FROM {_ARCS}")
def arc_project(spark, sf_dir):
    """Outputs relabelled, then both sides made the output."""
    g = _graph(spark, sf_dir)
    pairs = g.arcs.select(F.col("olabel").alias("old"), (F.col("olabel") * 2).alias("new")).distinct()
    return g.relabel(opairs=pairs).project("output").arcs.select("src", "ilabel", "olabel", "dst")


@query(f"SELECT count(*)::BIGINT AS n_arcs, count(*)::BIGINT AS n_forward FROM {_ARCS}")
def arc_topsort(spark, sf_dir):
    """In topological order every arc leads to a larger state."""
    return _graph(spark, sf_dir).topsort().arcs.agg(F.count(F.lit(1)).alias("n_arcs"), F.count_if(F.col("src") < F.col("dst")).alias("n_forward"))


@query("SELECT n_nationkey::BIGINT + 100 AS dst, least(3, n_regionkey + n_nationkey % 4)::DOUBLE AS weight FROM nation")
def arc_rmepsilon(spark, sf_dir):
    """Arcs to regions are silent: nations are reached straight from the start, by the cheaper way."""
    g = _graph(spark, sf_dir)
    silent = lambda c: F.when(F.col("dst") < 100, 0).otherwise(F.col(c)).cast("long").alias(c)
    arcs = g.arcs.select("src", silent("ilabel"), silent("olabel"), "weight", "dst")
    return ArcTable(g.states, arcs).rmepsilon().arcs.where("src = 0").select("dst", "weight")


@query(f"SELECT src, dst FROM {_ARCS} WHERE src % 3 <> 1 AND dst % 3 <> 1")
def arc_delete_states(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.delete_states(g.states.where("state % 3 = 1")).arcs.select("src", "dst")


@query("SELECT true AS equal_to_itself, false AS equal_without_weights")
def arc_equal(spark, sf_dir):
    g = _graph(spark, sf_dir)
    plain = ArcTable(g.states, g.arcs.withColumn("weight", F.lit(0.0)))
    return spark.createDataFrame([(g.equal(g), g.equal(plain))], "equal_to_itself boolean, equal_without_weights boolean")


# ---------------------------------------------------------------- machines made of a lexicon


def _lexicon(spark, sf_dir) -> list[str]:
    """The words of all names, few of them: a grammar, not a table."""
    return sorted(r.word for r in _words(table(spark, sf_dir, "part"), "p_name").collect())


def _strings(spark, m, *names):
    rows = [(i, o, float(w)) for i, o, w in M.items(m)]
    return spark.createDataFrame(rows, "istring string, ostring string, weight double").select(*(names or ("istring",)))


_W = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"


@query(f"SELECT word AS istring FROM {_W}")
def machine_minimize(spark, sf_dir):
    """Epsilons removed, determinized, minimized: the same strings."""
    return _strings(spark, M.minimize(M.determinize(M.rmepsilon(M.union(*_lexicon(spark, sf_dir))))))


@query(f"""
WITH p AS (SELECT left(word, k) AS head, substr(word, k + 1) AS tail FROM (SELECT word, unnest(range(0, length(word) + 1)) AS k FROM {_W}))
SELECT count(DISTINCT tails)::BIGINT AS n_states FROM (SELECT head, string_agg(tail, '/' ORDER BY tail) AS tails FROM p GROUP BY 1)""")
def minimal_states(spark, sf_dir):
    """A minimal acceptor has a state for each set of endings."""
    n = M.minimize(M.determinize(M.rmepsilon(M.union(*_lexicon(spark, sf_dir))))).num_states()
    return spark.createDataFrame([(n,)], "n_states long")


@query(f"SELECT word AS istring FROM {_W} WHERE word NOT LIKE '%e%'")
def machine_difference(spark, sf_dir):
    words = _lexicon(spark, sf_dir)
    return _strings(spark, M.difference(M.union(*words), M.optimize(M.union(*[w for w in words if "e" in w]))))


@query(f"SELECT word AS istring FROM {_W} WHERE length(word) BETWEEN 3 AND 5")
def machine_intersect(spark, sf_dir):
    letters = M.optimize(M.union(*"abcdefghijklmnopqrstuvwxyz"))
    return _strings(spark, M.intersect(M.union(*_lexicon(spark, sf_dir)), M.closure(letters, 3, 5)))


@query(f"SELECT 'the ' || word || '!' AS istring FROM {_W}")
def machine_replace(spark, sf_dir):
    """A grammar that calls the lexicon."""
    from ..labels import label_of_name

    noun = label_of_name("NOUN")
    return _strings(spark, M.replace(M.concat("the ", M.of_labels([noun]), "!"), {noun: M.union(*_lexicon(spark, sf_dir))}))


@query(f"SELECT word AS istring, reverse(word) AS ostring, length(word)::DOUBLE AS weight FROM {_W} ORDER BY weight, word LIMIT 1")
def machine_shortestpath(spark, sf_dir):
    """The least weight; ties are broken by making the first of equal words cheaper."""
    words = sorted(_lexicon(spark, sf_dir), key=lambda w: (len(w), w))
    found = M.shortestpath(M.string_map([(w, w[::-1], len(w) + k / 1e6) for k, w in enumerate(words)]))
    return _strings(spark, found, "istring", "ostring", F.round("weight", 3).alias("weight"))


@query(f"SELECT word AS istring, word AS ostring, -length(word)::DOUBLE + 20 AS weight FROM {_W}")
def machine_push(spark, sf_dir):
    """Weights pushed to the start and back again: the same sums."""
    m = M.string_map([(w, w, 20.0 - len(w)) for w in _lexicon(spark, sf_dir)])
    return _strings(spark, M.push(M.push(m), to_final=True), "istring", "ostring", F.round("weight", 6).alias("weight"))


@query("SELECT 0::BIGINT AS n_strange, 50::BIGINT AS n_drawn")
def machine_randgen(spark, sf_dir):
    words = _lexicon(spark, sf_dir)
    drawn = list(M.items(M.randgen(M.optimize(M.union(*words)), npath=50, seed=3)))
    return spark.createDataFrame([(sum(i not in set(words) for i, _, _ in drawn), 50)], "n_strange long, n_drawn long")


@query(f"SELECT word AS istring, upper(word) AS ostring FROM {_W}")
def machine_encode(spark, sf_dir):
    """Arcs encoded, minimized as an acceptor, and decoded."""
    m = M.string_map([(w, w.upper()) for w in _lexicon(spark, sf_dir)])
    code = M.EncodeMapper()
    return _strings(spark, code.decode(M.minimize(M.determinize(M.rmepsilon(code.encode(m))))), "istring", "ostring")


@query("SELECT p_partkey, replace(p_name, 'e', repeat('b', 1000)) AS long FROM part")
def rule_long(spark, sf_dir):
    """Outputs far longer than inputs."""
    letters = M.closure(M.optimize(M.union(*"abcdefghijklmnopqrstuvwxyz ")))
    rule = cdrewrite(M.cross("e", "b" * 1000), "", "", letters)
    return exploded(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", rule).select("p_partkey", F.col("ostring").alias("long"))


@query(f"SELECT DISTINCT word AS istring, reverse(word) AS ostring FROM {_W}")
def machine_synchronize(spark, sf_dir):
    """Silent moves apart, then side by side: the same pairs."""
    return _strings(spark, M.synchronize(M.string_map([(w, w[::-1]) for w in _lexicon(spark, sf_dir)])), "istring", "ostring")


@query(f"SELECT DISTINCT left(word, 2) AS istring, word AS ostring FROM {_W}")
def machine_epsnormalize(spark, sf_dir):
    return _strings(spark, M.epsnormalize(M.string_map([(w[:2], w) for w in _lexicon(spark, sf_dir)])), "istring", "ostring")


@query(f"""
WITH r AS (SELECT word, row_number() OVER (ORDER BY length(word), word) AS k FROM {_W})
SELECT left(word, 2) AS istring, arg_min(word, k) AS ostring FROM r GROUP BY 1""")
def machine_disambiguate(spark, sf_dir):
    """The best word of each pair of first letters."""
    words = sorted(_lexicon(spark, sf_dir), key=lambda w: (len(w), w))
    return _strings(spark, M.disambiguate(M.string_map([(w[:2], w, k) for k, w in enumerate(words)])), "istring", "ostring")


@query(f"SELECT f AS filter, word AS istring, upper(word) || '!' AS ostring FROM {_W}, (SELECT unnest(['alt_sequence', 'match', 'sequence']) AS f)")
def machine_compose_filters(spark, sf_dir):
    """Three orders of silent moves, each with one path a pair."""
    words = _lexicon(spark, sf_dir)
    left, right = M.concat(M.string_map([(w, w[::-1]) for w in words]), M.cross("", "?")), M.string_map([(w[::-1] + "?", w.upper() + "!") for w in words])
    rows = [(f, i, o) for f in ("alt_sequence", "match", "sequence") for i, o, _ in M.items(M.compose(left, right, compose_filter=f))]
    return spark.createDataFrame(rows, "filter string, istring string, ostring string")


@query(f"SELECT word AS istring, upper(word) AS ostring, length(word)::DOUBLE AS weight FROM {_W}")
def machine_bytes(spark, sf_dir):
    """Written as bytes and read back."""
    m = M.string_map([(w, w.upper(), len(w)) for w in _lexicon(spark, sf_dir)])
    return _strings(spark, M.of_bytes(M.to_bytes(m)), "istring", "ostring", "weight")


@query("SELECT true AS renumbered, false AS another_weight")
def machine_isomorphic(spark, sf_dir):
    """Words in another order give other state numbers."""
    words = _lexicon(spark, sf_dir)
    a, b = M.union(*words), M.union(*words[::-1])
    return spark.createDataFrame([(M.isomorphic(a, b), M.isomorphic(a, M.union(*words[1:], M.accep(words[0], 1))))], "renumbered boolean, another_weight boolean")


@query(f"SELECT word, [upper(word), word, word || word] AS strings, upper(word) AS best, [upper(word), word] AS two FROM {_W}")
def lattice_functions(spark, sf_dir):
    """All outputs of a word, the only best one and the best two."""
    words = _lexicon(spark, sf_dir)
    rule = M.string_map([row for w in words for row in ((w, w, 1), (w, w.upper(), 0.5), (w, w + w, 2), (w, w, 3))])
    rows = []
    for w in words:
        made = rewrite_lattice(w, rule)
        rows.append((w, lattice_to_strings(lattice_to_dfa(made)), lattice_to_one_top_string(made), lattice_to_strings(lattice_to_nshortest(made, 2))))
    return spark.createDataFrame(rows, "word string, strings array<string>, best string, two array<string>")


@query("SELECT p_partkey, replace(p_name, 'e', 'o') AS changed FROM part")
def rule_scalar(spark, sf_dir):
    """A rule as a function in SQL text."""
    letters = M.closure(M.optimize(M.union(*"abcdefghijklmnopqrstuvwxyz ")))
    register_scalar(spark, "e_to_o", cdrewrite(M.cross("e", "o"), "", "", letters))
    return spark.sql("SELECT p_partkey, e_to_o(p_name) AS changed FROM {parts}", parts=table(spark, sf_dir, "part"))


@query("SELECT o_orderkey, o_orderstatus AS status, split_part(o_orderpriority, '-', 1) AS urgency, '[status=' || o_orderstatus || '][urgency=' || split_part(o_orderpriority, '-', 1) || ']' AS again FROM orders")
def features_read(spark, sf_dir):
    """Feature symbols in a text to columns, and columns to symbols."""
    kinds = Category(Feature("status", "F", "O", "P"), Feature("urgency", "1", "2", "3", "4", "5"))
    first = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    text = F.concat(F.lit("x[urgency="), first, F.lit("][status="), F.col("o_orderstatus"), F.lit("]"))
    v = table(spark, sf_dir, "orders").select("o_orderkey", kinds.read(text).alias("v"))
    return v.select("o_orderkey", "v.status", "v.urgency", kinds.written(F.col("v")).alias("again"))


# ---------------------------------------------------------------- pushdown machines

PUSH, POP = 1_000_001, 1_000_002


def _nested(depth: int) -> M.Machine:
    return M.of_labels([PUSH] * depth + [97] * depth + [POP] * depth)


@query("SELECT DISTINCT p_size AS depth, repeat('a', p_size * 4) AS istring FROM part")
def pdt_expand(spark, sf_dir):
    """Brackets nested four times as deep as a part's size."""
    sizes = sorted(r.p_size for r in table(spark, sf_dir, "part").select("p_size").distinct().collect())
    parens = P.Parentheses([(PUSH, POP)])
    rows = [(n, i) for n in sizes for i, _, _ in M.items(P.expand(_nested(4 * n), parens))]
    return spark.createDataFrame(rows, "depth int, istring string")


@query("SELECT DISTINCT p_size AS depth, 'a' || repeat('b', p_size * 3) AS istring, p_size::DOUBLE AS weight FROM part")
def pdt_shortestpath(spark, sf_dir):
    """Of two readings of nested brackets, the cheaper one."""
    sizes = sorted(r.p_size for r in table(spark, sf_dir, "part").select("p_size").distinct().collect())
    parens = P.Parentheses([(PUSH, POP)])
    rows = []
    for n in sizes:
        deep = lambda first, w: M.concat(M.of_labels([PUSH] * 3 * n), M.accep(first, weight=w), M.of_labels([98] * 3 * n), M.of_labels([POP] * 3 * n))  # noqa: E731,B023
        best = P.shortestpath(M.union(deep("c", n + 1), deep("a", n)), parens)
        rows += [(n, i, float(w)) for i, _, w in M.items(best)]
    return spark.createDataFrame(rows, "depth int, istring string, weight double")


@query("SELECT p_partkey, p_size % 2 = 0 AS balanced FROM part")
def pdt_accepts(spark, sf_dir):
    """a^k b^k by a grammar that calls itself; odd sizes lack a letter.  Each of the fifty sizes is asked once."""
    from ..labels import label_of_name, to_labels

    s = label_of_name("S")
    m, parens = P.replace(M.of_labels([s]), {s: M.union("", M.concat("a", M.of_labels([s]), "b"))})
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sizes = [r.p_size for r in parts.select("p_size").distinct().collect()]
    rows = [(n, P.accepts(m, parens, to_labels("a" * (n // 2 + n % 2) + "b" * (n // 2)))) for n in sizes]
    return parts.join(F.broadcast(spark.createDataFrame(rows, "p_size int, balanced boolean")), "p_size").select("p_partkey", "balanced")


# ---------------------------------------------------------------- grammars


@query("""
SELECT o_orderkey, 'on <date><month>' || month(o_orderdate) || '</month><day>' || day(o_orderdate) || '</day><year>' || year(o_orderdate) || '</year></date> or <date><day>' || day(o_orderdate) || '</day><month>' || month(o_orderdate) || '</month><year>' || year(o_orderdate) || '</year></date>, in <date><month>' || month(o_orderdate) || '</month><year>' || year(o_orderdate) || '</year></date>' AS tagged FROM orders""")
def date_forms(spark, sf_dir):
    """Month names, with a day before or after and without one."""
    d = F.col("o_orderdate")
    text = F.concat(F.lit("on "), F.date_format(d, "MMMM d, yyyy"), F.lit(" or "), F.date_format(d, "d MMM yyyy"), F.lit(", in "), F.date_format(d, "MMMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.tag_dates(text).alias("tagged"))


_SOUNDS = [("ch", "t\u0283"), ("ll", "\u029d"), ("qu", "k")]
_STEPS = "word"
for _a, _b in _SOUNDS:
    _STEPS = f"replace({_STEPS}, '{_a}', '{_b}')"
_STEPS = f"replace(translate({_STEPS}, 'jvxy', 'xbsj'), 'h', '')"
# a consumed vowel may be the left side of the next tap, so the step is taken twice
_TAP = [("([aeiou])r([aeiou])", "\\1\u027e\\2")] * 2
for _a, _b in [*_TAP, ("rr", "r"), ("c([ie])", "s\\1"), ("g([ie])", "x\\1"), ("c", "k")]:
    _STEPS = f"regexp_replace({_STEPS}, '{_a}', '{_b}', 'g')"


@query(f"SELECT word, {_STEPS} AS sounds FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)")
def g2p_names(spark, sf_dir):
    """Words of names read as if they were Spanish."""
    words = _words(table(spark, sf_dir, "part"), "p_name")
    return words.select("word", g2p.sounds(F.col("word")).alias("sounds"))


@query(f"SELECT word || 'is' AS word, CASE WHEN regexp_matches(word, '[sx]$') THEN word || 'es' ELSE word || 'ises' END AS plural FROM {_W}")
def plural_is(spark, sf_dir):
    """Words in -is after s or x and after other letters."""
    words = _words(table(spark, sf_dir, "part"), "p_name").select(F.concat("word", F.lit("is")).alias("word"))
    return words.select("word", plurals.plural(F.col("word")).alias("plural"))


@query(f"""
WITH w AS {_W}, t AS (SELECT word, word[1] || regexp_replace(substr(word, 2), '[aeiou]', '', 'g') AS token FROM w)
SELECT DISTINCT a.token, b.word AS ostring FROM t a JOIN t b ON a.token = b.token WHERE a.token NOT IN (SELECT word FROM w) AND length(a.token) >= 2 AND length(b.word) >= 3""")
def chat_candidates(spark, sf_dir):
    """Words whose abbreviation leaves all vowels out, found again from it."""
    words = _words(table(spark, sf_dir, "part"), "p_name")
    tokens = words.select(chat.skeleton(F.col("word")).alias("token")).distinct().where("length(token) >= 2")
    tokens = tokens.join(words.select(F.col("word").alias("token")), "token", "left_anti")
    found = chat.candidates(tokens, "token", words, "word").where("weight = 1")
    back = found.join(words, F.col("ostring") == F.col("word")).where(chat.skeleton(F.col("word")) == F.col("token"))
    return back.select("token", "ostring").distinct()


@query("SELECT a.n_name || b.r_name AS istring FROM nation a, region b")
def concat_tables(spark, sf_dir):
    """Strings of one table followed by those of another."""
    a = Relation.of_column(table(spark, sf_dir, "nation"), "n_name")
    return a.concat(Relation.of_column(table(spark, sf_dir, "region"), "r_name")).df.select("istring")


@query("SELECT a.n_name AS istring, b.r_name AS ostring FROM nation a, region b")
def cross_tables(spark, sf_dir):
    a = Relation.of_column(table(spark, sf_dir, "nation"), "n_name")
    return a.cross(Relation.of_column(table(spark, sf_dir, "region"), "r_name")).df.select("istring", "ostring")


__all__ = ["QUERIES", "SQL"]
