"""Queries over the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import native
from ..grammars import case, chat, dates, keypad, numbers, plurals, tagger, weather
from ..operators import edit, morphology, relation, term_tags
from ..operators.apply import exploded
from ..operators.arcs import ArcTable
from ..operators.machine import closure, string_map, union
from ..operators.relation import Relation
from ..operators.rules import cdrewrite

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(df, column):
    return df.select(F.explode(F.split(column, " ")).alias("word")).where("word <> ''").distinct()


def _rows(pairs, *names):
    cells = lambda r: ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) for x in r)
    return "(VALUES " + ", ".join(f"({cells(r)})" for r in pairs) + f") AS t({', '.join(names)})"


# ---------------------------------------------------------------- maps and lexicons

SYNONYMS = [("small", "tiny", 1.0), ("small", "little", 0.5), ("red", "crimson", 1.0), ("red", "ruby", 1.0), ("hot", "warm", 0.25), ("blue", "azure", 2.0), ("ring", "band", 0.75), ("bolt", "screw", 1.5), ("gear", "cog", 0.5)]
_SYN = _rows(SYNONYMS, "istring", "ostring", "weight")


@query(f"""
WITH names AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1),
tok AS (SELECT p_name, generate_subscripts(string_split(p_name, ' '), 1) AS pos, unnest(string_split(p_name, ' ')) AS word FROM names),
best AS (SELECT istring, ostring, weight FROM (SELECT *, row_number() OVER (PARTITION BY istring ORDER BY weight, ostring) AS k FROM {_SYN}) WHERE k = 1),
done AS (SELECT p_name, string_agg(coalesce(ostring, word), ' ' ORDER BY pos) AS best_name, round(sum(coalesce(weight, 0)), 6) AS weight FROM tok LEFT JOIN best ON istring = word GROUP BY 1)
SELECT best_name, min(weight)::DOUBLE AS weight, sum(n)::BIGINT AS n_parts FROM done JOIN names USING (p_name) GROUP BY 1""")
def map_best_name(spark, sf_dir):
    """Names with every word replaced by its best synonym, and how many parts get each."""
    names = table(spark, sf_dir, "part").groupBy("p_name").count()
    tokens = names.select("p_name", F.posexplode(F.split("p_name", " ")).alias("at", "istring")).select("*", F.col("istring").alias("ostring"), F.lit(0.0).alias("weight"))
    best = Relation.of_rows(spark, SYNONYMS).shortest(1).df.select(F.col("istring").alias("i"), F.col("ostring").alias("o"), F.col("weight").alias("w"))
    found = tokens.join(F.broadcast(best), F.col("istring") == F.col("i"), "left")
    done = found.groupBy("p_name").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("o", "istring").alias("word")))).alias("words"), F.round(F.sum(F.coalesce("w", F.lit(0.0))), 6).alias("weight"))
    text = F.array_join(F.transform("words", lambda x: x["word"]), " ")
    return done.join(names, "p_name").groupBy(text.alias("best_name")).agg(F.min("weight").alias("weight"), F.sum("count").alias("n_parts"))


@query(f"""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word AS istring, coalesce(ostring, word) AS ostring, coalesce(weight, 0.0)::DOUBLE AS weight FROM w LEFT JOIN {_SYN} ON istring = word""")
def lenient_words(spark, sf_dir):
    """Lenient composition: synonyms where there are some, the word itself elsewhere."""
    return Relation.of_column(_words(table(spark, sf_dir, "part"), "p_name"), "word").leniently_compose(Relation.of_rows(spark, SYNONYMS)).df


@query(f"""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT istring, ostring, weight::DOUBLE AS weight FROM {_SYN} UNION ALL SELECT word, word || 's', 9.0 FROM w WHERE word NOT IN (SELECT istring FROM {_SYN})""")
def priority_union_synonyms(spark, sf_dir):
    words = _words(table(spark, sf_dir, "part"), "p_name").select(F.col("word").alias("istring"), F.concat("word", F.lit("s")).alias("ostring"), F.lit(9.0).alias("weight"))
    return Relation.of_rows(spark, SYNONYMS).priority_union(Relation(words)).df


@query("SELECT p_partkey, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999') AS keys FROM part")
def keypad_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", native.keypad(F.col("p_name")).alias("keys"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT a.word AS typed, b.word AS word FROM w a JOIN w b ON translate(a.word, 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999') = translate(b.word, 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999')""")
def keypad_collide(spark, sf_dir):
    """Every word that the keys of a word may stand for."""
    words = _words(table(spark, sf_dir, "part"), "p_name")
    typed = words.select(F.col("word").alias("typed"), native.keypad(F.col("word")).alias("keys"))
    return keypad.decode(typed, "keys", words, "word").select("typed", "word")


# ---------------------------------------------------------------- algebra


def _events(spark, sf_dir, kind=None):
    e = table(spark, sf_dir, "events")
    e = e.where(F.col("event_type") == kind) if kind else e
    return Relation(e.select(F.col("user_id").cast("string").alias("istring"), F.col("event_type").alias("ostring"), F.col("value").alias("weight")))


@query("SELECT istring, ostring, min(weight) AS weight FROM (SELECT user_id::VARCHAR AS istring, event_type AS ostring, value AS weight FROM events WHERE event_type = 'click' UNION ALL SELECT user_id::VARCHAR, event_type, value FROM events WHERE event_type = 'view') GROUP BY 1, 2")
def rel_union_min(spark, sf_dir):
    return _events(spark, sf_dir, "click").union(_events(spark, sf_dir, "view")).merged().df


@query("SELECT user_id::VARCHAR AS istring, event_type AS ostring, round(-ln(sum(exp(-value / 1000))), 6) AS weight FROM events GROUP BY 1, 2")
def rel_union_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("istring"), F.col("event_type").alias("ostring"), (F.col("value") / 1000).alias("weight"))
    return Relation(e, "log").merged().df.withColumn("weight", F.round("weight", 6))


@query("""
SELECT c_name AS istring, r_name AS ostring, (c_custkey % 7 + n_nationkey % 5 + 1)::DOUBLE AS weight
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def compose_chain(spark, sf_dir):
    """Customer to nation to region; weights along the way."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    text = lambda x: F.col(x).cast("string")
    first = Relation(c.select(F.col("c_name").alias("istring"), text("c_nationkey").alias("ostring"), (F.col("c_custkey") % 7).alias("weight")))
    second = Relation(n.select(text("n_nationkey").alias("istring"), text("n_regionkey").alias("ostring"), (F.col("n_nationkey") % 5).alias("weight")))
    third = Relation(r.select(text("r_regionkey").alias("istring"), F.col("r_name").alias("ostring"), F.lit(1.0).alias("weight")))
    return first.compose(second).compose(third).df


_DOC_WORDS = "(SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL)"
_BENCH_WORDS = "(SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark WHERE text IS NOT NULL)"


def _acceptor(spark, sf_dir, name):
    return Relation.of_column(_words(table(spark, sf_dir, name), "text"), "word")


@query(f"SELECT word AS istring, word AS ostring, 0.0::DOUBLE AS weight FROM {_DOC_WORDS} WHERE word <> '' AND word IN (SELECT word FROM {_BENCH_WORDS})")
def intersect_words(spark, sf_dir):
    return _acceptor(spark, sf_dir, "documents").intersect(_acceptor(spark, sf_dir, "benchmark")).df


@query(f"SELECT word AS istring, word AS ostring, 0.0::DOUBLE AS weight FROM {_BENCH_WORDS} WHERE word <> '' AND word NOT IN (SELECT word FROM {_DOC_WORDS})")
def diff_words(spark, sf_dir):
    return _acceptor(spark, sf_dir, "benchmark").difference(_acceptor(spark, sf_dir, "documents")).df


@query("SELECT r_name || ' / ' || r_name AS istring, 'x' AS ostring, r_regionkey::DOUBLE + 2 AS weight FROM region")
def concat_cross(spark, sf_dir):
    """Concatenation with literals on both sides, then a cross product."""
    r = table(spark, sf_dir, "region")
    name = Relation(r.select(F.concat("r_name", F.lit(" / "), "r_name").alias("istring"), F.lit("").alias("ostring"), F.col("r_regionkey").alias("weight")))
    return name.concat(Relation.of_rows(spark, [("", "", 1.0)])).cross(Relation.of_rows(spark, [("x", "x", 1.0)])).df


@query("""
WITH RECURSIVE w AS (SELECT r_name AS s, 1 AS n, r_regionkey::DOUBLE AS weight FROM region UNION ALL SELECT s || r_name, n + 1, weight + r_regionkey FROM w, region WHERE n < 3)
SELECT s AS istring, s AS ostring, min(weight) AS weight FROM w GROUP BY 1, 2""")
def closure_bounded(spark, sf_dir):
    """One to three region names in a row."""
    names = [(r.r_name, r.r_name, float(r.r_regionkey)) for r in table(spark, sf_dir, "region").collect()]  # a table of fixed size
    return Relation.of_rows(spark, names).closure(1, 3).df


@query("SELECT reverse(n_name) AS istring, n_name AS ostring, n_nationkey::DOUBLE AS weight FROM nation")
def invert_reverse(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.reverse("n_name").alias("istring"), F.reverse(F.reverse("n_name")).alias("ostring"), F.col("n_nationkey").alias("weight"))
    return Relation(n).invert().reverse().invert().reverse().df


@query("SELECT event_type AS istring, event_type AS ostring, min(value) AS weight FROM events GROUP BY 1")
def project_output(spark, sf_dir):
    return _events(spark, sf_dir).project("output").merged().df


# ---------------------------------------------------------------- ranking


def _candidates(spark, sf_dir):
    return _events(spark, sf_dir).df.withColumnRenamed("istring", "user")


_CAND = "(SELECT user_id::VARCHAR AS \"user\", event_type AS ostring, min(value) AS weight FROM events GROUP BY 1, 2)"


@query(f'SELECT "user", ostring, weight FROM {_CAND}')
def all_rewrites(spark, sf_dir):
    return relation.rewrites(_candidates(spark, sf_dir), ["user"])


@query(f'SELECT "user", ostring, weight FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY floor(weight / 1e-6 + 0.5), ostring) AS k FROM {_CAND}) WHERE k <= 3')
def top_k_rewrites(spark, sf_dir):
    return relation.top(relation.rewrites(_candidates(spark, sf_dir), ["user"]), ["user"], 3)


@query("""
SELECT p_brand, p_type AS ostring, weight FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY weight) AS k FROM (SELECT p_brand, p_type, min(p_size)::DOUBLE AS weight FROM part GROUP BY 1, 2)) WHERE k = 1""")
def optimal_rewrites(spark, sf_dir):
    """All types that tie for a brand's least size."""
    c = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("ostring"), F.col("p_size").cast("double").alias("weight"))
    return relation.optimal(relation.rewrites(c, ["p_brand"]), ["p_brand"])


@query("""
WITH c AS (SELECT p_brand, p_type, min(p_size)::DOUBLE AS weight FROM part GROUP BY 1, 2), b AS (SELECT p_brand, min(weight) AS weight FROM c GROUP BY 1)
SELECT p_brand, CASE WHEN count(*) = 1 THEN min(p_type) END AS ostring, min(c.weight) AS weight FROM c JOIN b USING (p_brand) WHERE c.weight = b.weight GROUP BY 1""")
def one_top_rewrite(spark, sf_dir):
    """The only best type, or null where several tie."""
    c = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("ostring"), F.col("p_size").cast("double").alias("weight"))
    return relation.only_best(c, ["p_brand"], strict=False)


@query("SELECT user_id::VARCHAR AS istring, event_type AS ostring, value AS weight FROM events QUALIFY value <= min(value) OVER (PARTITION BY user_id) + 1")
def prune_candidates(spark, sf_dir):
    return _events(spark, sf_dir).prune(1.0, per_input=True).df


@query("SELECT user_id::VARCHAR AS istring, event_type AS ostring, value AS weight FROM events WHERE value <= (SELECT min(value) FROM events) + 5")
def prune_all(spark, sf_dir):
    return _events(spark, sf_dir).prune(5.0).df


@query("""
SELECT istring, ostring, weight FROM (SELECT user_id::VARCHAR AS istring, event_type AS ostring, value AS weight, row_number() OVER (PARTITION BY user_id ORDER BY value, event_type) AS k FROM events) WHERE k = 1""")
def disambiguated(spark, sf_dir):
    return _events(spark, sf_dir).disambiguate().df


@query("SELECT user_id::VARCHAR AS istring, event_type AS ostring FROM events WHERE event_type = 'click' GROUP BY 1, 2")
def matching_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("istring"), F.lit("click").alias("ostring")).distinct()
    return _events(spark, sf_dir).merged().matches(pairs)


# ---------------------------------------------------------------- edit distance

LEXICON = ["smal", "tall", "ret", "bleu", "green", "bolts", "rings", "gears", "cold", "hut", "widgets", "nuts", "screw"]
_LEX = _rows([(w,) for w in LEXICON], "lex")


@query(f"""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), d AS (SELECT word, lex, levenshtein(word, lex) AS k FROM w, {_LEX})
SELECT word, lex AS ostring, k::DOUBLE AS weight FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY k) AS r FROM d) WHERE r = 1""")
def edit_closest(spark, sf_dir):
    """The nearest lexicon words of each word however far, ties included."""
    lexicon = spark.createDataFrame([(w,) for w in LEXICON], "lex string")
    return edit.closest(_words(table(spark, sf_dir, "part"), "p_name"), "word", lexicon, "lex", 0, all_ties=True)


@query("""
WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE regexp_full_match(w, '[a-z]{3,9}')), p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
d AS (SELECT word, w, levenshtein(word, w) AS k FROM p, w)
SELECT word, w AS ostring, k::DOUBLE AS weight FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY k) AS r FROM d) WHERE r = 1""")
def edit_closest_table(spark, sf_dir):
    """The nearest words of conversations for each word of a part's name, without a bound."""
    lexicon = _words(table(spark, sf_dir, "conversations"), "text").where("word rlike '^[a-z]{3,9}$'").withColumnRenamed("word", "w")
    return edit.closest(_words(table(spark, sf_dir, "part"), "p_name"), "word", lexicon, "w", 0, all_ties=True)


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::BIGINT AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def edit_pairs(spark, sf_dir):
    a, b = (table(spark, sf_dir, "nation").select(F.col("n_name").alias(x), F.col("n_nationkey").alias(f"k{x}")) for x in "ab")
    return a.join(b, F.col("ka") < F.col("kb")).select("a", "b", native.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


# ---------------------------------------------------------------- rules


@query("SELECT o_orderkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN s[i] = '1' AND i > 1 AND s[i - 1] = '1' THEN '0' ELSE s[i] END), '') AS output FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS s FROM orders)")
def rule_sim(spark, sf_dir):
    """1 to 0 after an input 1."""
    return table(spark, sf_dir, "orders").select("o_orderkey", native.literal_rule(F.col("o_orderkey").cast("string"), "1", "0", "1", "", "sim").alias("output"))


@query("SELECT o_orderkey, list_reduce(string_split(o_orderkey::VARCHAR, ''), lambda a, x: CASE WHEN x = '1' AND right(a, 1) = '1' THEN a || '0' ELSE a || x END) AS output FROM orders")
def rule_ltr(spark, sf_dir):
    """1 to 0 after an output 1, from the left."""
    return table(spark, sf_dir, "orders").select("o_orderkey", native.literal_rule(F.col("o_orderkey").cast("string"), "1", "0", "1", "", "ltr").alias("output"))


@query("SELECT o_orderkey, reverse(list_reduce(string_split(reverse(o_orderkey::VARCHAR), ''), lambda a, x: CASE WHEN x = '1' AND right(a, 1) = '1' THEN a || '0' ELSE a || x END)) AS output FROM orders")
def rule_rtl(spark, sf_dir):
    """1 to 0 before an output 1, from the right."""
    return table(spark, sf_dir, "orders").select("o_orderkey", native.literal_rule(F.col("o_orderkey").cast("string"), "1", "0", "", "1", "rtl").alias("output"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word, word AS ostring, 0.0::DOUBLE AS weight FROM w UNION ALL SELECT word, left(word, length(word) - 1), 0.0 FROM w WHERE right(word, 1) IN ('t', 'd')""")
def rule_opt(spark, sf_dir):
    """Optional loss of a final t or d: every output, through the kernel."""
    letters = closure(union(*"abcdefghijklmnopqrstuvwxyz"))
    return exploded(_words(table(spark, sf_dir, "part"), "p_name"), "word", cdrewrite(string_map([("t", ""), ("d", "")]), "", "[EOS]", letters, mode="opt"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word, translate(word, 'aeou', 'iiii') AS ostring, (length(word) - length(translate(word, 'aeou', '')))::DOUBLE AS weight FROM w""")
def rule_weighted(spark, sf_dir):
    """Vowels to i at a cost of 1 each, or to y at 2: the best output, ranked in the kernel."""
    letters = closure(union(*"abcdefghijklmnopqrstuvwxyz"))
    tau = string_map([(v, o, w) for v in "aeou" for o, w in (("i", 1.0), ("y", 2.0))])
    return exploded(_words(table(spark, sf_dir, "part"), "p_name"), "word", cdrewrite(tau, "", "", letters), "optimal")


@query("SELECT doc_id, md5(regexp_replace(text, '(the|of|and)', '<w>\\1</w>', 'g')) AS tagged_md5 FROM documents")
def tag_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(native.tag_terms(F.col("text"), ["the", "of", "and"], "w")).alias("tagged_md5"))


@query("SELECT p_partkey, regexp_replace(p_name, '(ringed|ring|red|bolt)', '<k>\\1</k>', 'g') AS tagged FROM part")
def tag_longest(spark, sf_dir):
    """Terms that are parts of each other: the longest wins."""
    t = tagger.Tagger("k", ("red", "ring", "ringed", "bolt"))
    return table(spark, sf_dir, "part").select("p_partkey", t.apply(F.col("p_name")).alias("tagged"))


@query("""
WITH lex AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE length(w) >= 3),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, ' ') AS l FROM documents WHERE text IS NOT NULL),
t AS (SELECT rid, doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM d),
p AS (SELECT token, unnest(range(3, length(token) + 1)) AS k FROM (SELECT DISTINCT token FROM t)),
b AS (SELECT token, max(k) AS k FROM p SEMI JOIN lex ON w = left(token, k) GROUP BY 1)
SELECT doc_id, count(k) FILTER (pos > 1)::BIGINT AS n_terms,
  md5(string_agg(CASE WHEN pos = 1 THEN token WHEN k IS NULL THEN ' ' || token ELSE '<k> ' || left(token, k) || '</k>' || substr(token, k + 1) END, '' ORDER BY pos)) AS tagged_md5
FROM t LEFT JOIN b USING (token) GROUP BY rid, doc_id""")
def tag_table(spark, sf_dir):
    """Words of conversations, each with the space before it, as a lexicon table: the longest that a word of a document begins with."""
    words = _words(table(spark, sf_dir, "conversations"), "text").where("length(word) >= 3").select(F.concat(F.lit(" "), "word").alias("term"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    found = term_tags.tagged(docs, "text", words, "term", "k")
    return found.select("doc_id", ((F.length("tagged") - F.length("text")) / 7).cast("long").alias("n_terms"), F.md5("tagged").alias("tagged_md5"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM conversations WHERE text IS NOT NULL)
SELECT word, list_reduce(string_split(word, ''), lambda a, x: CASE WHEN x BETWEEN 'a' AND 'z' AND right(a, 1) = x THEN a ELSE a || x END) AS single FROM w WHERE word <> ''""")
def dedup_letters(spark, sf_dir):
    return _words(table(spark, sf_dir, "conversations"), "text").select("word", chat.without_doubles(F.col("word")).alias("single"))


@query("SELECT p_partkey, replace(replace('[' || p_name || ']', '[', '\\['), ']', '\\]') AS escaped FROM part")
def escape_brackets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", native.escape(F.concat(F.lit("["), "p_name", F.lit("]"))).alias("escaped"))


@query("SELECT doc_id, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digit, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) AS n_space, length(text) - length(regexp_replace(text, '[!-~]', '', 'g')) AS n_graph FROM documents")
def byte_classes(spark, sf_dir):
    n = lambda name: native.count_of(F.col("text"), name).cast("long").alias(f"n_{name.lower()}")
    return table(spark, sf_dir, "documents").select("doc_id", n("DIGIT"), n("UPPER"), n("SPACE"), n("GRAPH"))


@query("SELECT conv_id, turn, strlen(text) - length(text) AS n_continuation, true AS is_valid FROM conversations")
def utf8_valid(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lead = native.utf8_lead(F.col("text"))
    return c.select("conv_id", "turn", lead["continuation"].cast("long").alias("n_continuation"), native.is_valid_utf8(F.col("text")).alias("is_valid"))


# ---------------------------------------------------------------- grammars

_ONES = "['" + "', '".join(numbers.ONES) + "']"
_TENS = "['" + "', '".join(numbers.TENS) + "']"


def _hundreds(n):
    return f"""CASE WHEN {n} > 0 THEN concat_ws(' ', CASE WHEN {n} >= 100 THEN ({_ONES})[{n} // 100] || ' hundred' END,
CASE WHEN {n} % 100 BETWEEN 1 AND 19 THEN ({_ONES})[{n} % 100] END, CASE WHEN {n} % 100 >= 20 THEN ({_TENS})[({n} % 100) // 10 - 1] END,
CASE WHEN {n} % 100 >= 20 AND {n} % 10 > 0 THEN ({_ONES})[{n} % 10] END) END"""


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1 AND 9999999 THEN concat_ws(' ', ({_hundreds('(o_orderkey // 1000000 % 1000)')}) || ' million', ({_hundreds('(o_orderkey // 1000 % 1000)')}) || ' thousand', {_hundreds('(o_orderkey % 1000)')}) END AS name FROM orders")
def number_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.number_name(F.col("o_orderkey")).alias("name"))


@query("SELECT o_orderkey, 'due <date><year>' || year(o_orderdate) || '</year><month>' || month(o_orderdate) || '</month><day>' || day(o_orderdate) || '</day></date>, or <date><day>' || day(o_orderdate) || '</day><month>' || month(o_orderdate) || '</month><year>' || year(o_orderdate) || '</year></date>.' AS tagged FROM orders")
def date_tag(spark, sf_dir):
    """Dates in numbers: year first, or day first."""
    d = F.col("o_orderdate")
    text = F.concat(F.lit("due "), F.concat_ws("/", F.year(d), F.month(d), F.dayofmonth(d)), F.lit(", or "), F.concat_ws("/", F.dayofmonth(d), F.month(d), F.year(d)), F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.tag_dates(text).alias("tagged"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, length(word) - 1) || 'ies' WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' ELSE word || 's' END AS plural FROM w""")
def plural_names(spark, sf_dir):
    return _words(table(spark, sf_dir, "part"), "p_name").select("word", plurals.plural(F.col("word")).alias("plural"))


@query("""
SELECT s_name, 'It is ' || d || CASE WHEN d IN (1, -1) THEN ' degree' ELSE ' degrees' END || ' in ' || s_name || '.' AS report FROM (SELECT s_name, floor(s_acctbal / 1000)::BIGINT AS d FROM supplier)""")
def weather_reports(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_name", F.floor(F.col("s_acctbal") / 1000).alias("degrees"))
    return weather.reports(s, "It is [DEGREES] degrees in [S_NAME].", "s_name")


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word, word || CASE WHEN regexp_matches(word, '[aou][^aouäöy]*$') THEN 'ssa' ELSE 'ssä' END AS inessive FROM w""")
def case_endings(spark, sf_dir):
    return _words(table(spark, sf_dir, "part"), "p_name").select("word", case.case_of(F.col("word"), "inessive").alias("inessive"))


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}'']+'), lambda t: t <> '')"


@query(f"""
WITH t AS (SELECT list_concat(['<s>'], {_TOKENS}, ['</s>']) AS t FROM conversations WHERE text IS NOT NULL),
g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: [t[i], t[i + 1]])) AS g FROM t)
SELECT g[1] AS first, g[2] AS second, count(*) AS n FROM g GROUP BY 1, 2""")
def lm_bigrams(spark, sf_dir):
    return chat.ngram_counts(table(spark, sf_dir, "conversations"), "text", 2).select(F.col("gram")[0].alias("first"), F.col("gram")[1].alias("second"), "n")


@query(f"""
WITH t AS (SELECT list_concat(['<s>'], {_TOKENS}, ['</s>']) AS t FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: [t[i], t[i + 1]])) AS g FROM t),
two AS (SELECT g[1] AS first, g[2] AS second, count(*) AS n FROM g GROUP BY 1, 2), ctx AS (SELECT first, sum(n) AS total, count(*) AS kinds FROM two GROUP BY 1), uni AS (SELECT second, sum(n) AS m FROM two GROUP BY 1), every AS (SELECT sum(n) AS c FROM two)
SELECT first, second, round(-ln((n + kinds * m / c) / (total + kinds)), 6) AS cost FROM two JOIN ctx USING (first) JOIN uni USING (second), every
UNION ALL SELECT first, NULL, round(-ln(kinds / (total + kinds)), 6) FROM ctx""")
def lm_bigram_costs(spark, sf_dir):
    """Witten-Bell costs of word pairs."""
    return chat.bigram_model(table(spark, sf_dir, "benchmark"), "text").withColumn("cost", F.round("cost", 6))


# ---------------------------------------------------------------- paradigms

_NUM, _CASE = morphology.Feature("num", "sg", "pl"), morphology.Feature("case", "base", "of")
_NOUN = morphology.Category(_NUM, _CASE)


def _noun(spark, sf_dir):
    v = lambda *p: morphology.FeatureVector(_NOUN, *p)
    slots = [("{}", v("num=sg", "case=base")), ("{}+s", v("num=pl", "case=base")), ("of +{}", v("num=sg", "case=of")), ("of +{}+s", v("num=pl", "case=of"))]
    stems = _words(table(spark, sf_dir, "part"), "p_name").withColumnRenamed("word", "stem")
    return morphology.Paradigm(_NOUN, slots, slots[0][1], stems, [lambda c: F.regexp_replace(c, r"y\+s", "ie+s")])


_FORMS = """(WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
s AS (SELECT * FROM (VALUES (0, '', '', '[case=base][num=sg]'), (1, '', '+s', '[case=base][num=pl]'), (2, 'of +', '', '[case=of][num=sg]'), (3, 'of +', '+s', '[case=of][num=pl]')) AS t(slot, before, after, features))
SELECT word AS stem, slot, regexp_replace(before || word || after, 'y\\+s', 'ie+s', 'g') AS form, features FROM w, s)"""


@query(f"SELECT stem, slot, form, features FROM {_FORMS}")
def paradigm_forms(spark, sf_dir):
    return _noun(spark, sf_dir).forms(spark).select("stem", "slot", "form", "features")


@query(f"SELECT stem || 's' AS word, form, features FROM {_FORMS} f WHERE EXISTS (SELECT 1 FROM {_FORMS} g WHERE g.stem || 's' = replace(f.form, '+', '') AND g.stem = f.stem)")
def paradigm_analyze(spark, sf_dir):
    words = _words(table(spark, sf_dir, "part"), "p_name").select(F.concat("word", F.lit("s")).alias("word"))
    return _noun(spark, sf_dir).analyze(words, "word")


@query(f"SELECT replace(form, '+', '') AS word, stem AS lemma, features FROM {_FORMS}")
def paradigm_lemmatize(spark, sf_dir):
    p = _noun(spark, sf_dir)
    return p.lemmatize(p.forms(spark).select(F.col("surface").alias("word")).distinct(), "word")


@query(f"SELECT stem AS lemma, replace(form, '+', '') AS form FROM {_FORMS} WHERE features = '[case=of][num=pl]'")
def paradigm_inflect(spark, sf_dir):
    lemmas = _words(table(spark, sf_dir, "part"), "p_name").select(F.col("word").alias("lemma"))
    return _noun(spark, sf_dir).inflect(lemmas, "lemma", morphology.FeatureVector(_NOUN, "num=pl", "case=of"))


# ---------------------------------------------------------------- arc tables


def _graph(spark, sf_dir):
    """Start 0 to regions (1 + key), to nations (100 + key), to customers (1000 + key); nations also straight from 0 at 3."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    arc = lambda df, src, dst, w: df.select(src.cast("long").alias("src"), dst.cast("long").alias("ilabel"), dst.cast("long").alias("olabel"), w.cast("double").alias("weight"), dst.cast("long").alias("dst"))
    arcs = arc(r, F.lit(0), F.col("r_regionkey") + 1, F.col("r_regionkey"))
    arcs = arcs.unionByName(arc(n, F.col("n_regionkey") + 1, F.col("n_nationkey") + 100, F.col("n_nationkey") % 4))
    arcs = arcs.unionByName(arc(n, F.lit(0), F.col("n_nationkey") + 100, F.lit(3)))
    arcs = arcs.unionByName(arc(c, F.col("c_nationkey") + 100, F.col("c_custkey") + 1000, F.col("c_custkey") % 10))
    states = arcs.select(F.explode(F.array("src", "dst")).alias("state")).distinct()
    final = F.when((F.col("state") >= 1000) & (F.col("state") % 2 == 0), 0.0)
    return ArcTable(states.select("state", (F.col("state") == 0).alias("is_start"), final.alias("final_weight")), arcs)


@query("""
WITH n AS (SELECT n_nationkey, least(3, n_regionkey + n_nationkey % 4) AS d FROM nation)
SELECT 0::BIGINT AS state, 0.0::DOUBLE AS distance UNION ALL SELECT r_regionkey + 1, r_regionkey::DOUBLE FROM region UNION ALL SELECT n_nationkey + 100, d FROM n
UNION ALL SELECT c_custkey + 1000, d + c_custkey % 10 FROM customer JOIN n ON c_nationkey = n_nationkey""")
def arc_shortest(spark, sf_dir):
    return _graph(spark, sf_dir).shortestdistance()


@query("SELECT c_nationkey::BIGINT + 100 AS src, c_custkey + 1000 AS dst FROM customer WHERE c_custkey % 2 = 0")
def arc_connect(spark, sf_dir):
    """Arcs to final states that lie on a path."""
    return _graph(spark, sf_dir).connect().arcs.where("dst >= 1000").select("src", "dst")


@query("""
SELECT r_regionkey::BIGINT + 1 AS region, n_nationkey::BIGINT + 100 AS nation, c_custkey + 1000 AS customer, (r_regionkey + n_nationkey % 4 + c_custkey % 10)::DOUBLE AS weight
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0
UNION ALL SELECT NULL, c_nationkey::BIGINT + 100, c_custkey + 1000, (3 + c_custkey % 10)::DOUBLE FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0""")
def paths_enum(spark, sf_dir):
    """Every path from the start to a final customer."""
    p = _graph(spark, sf_dir).paths()
    at = lambda k: F.try_element_at("olabels", F.lit(k))
    return p.select(at(-3).alias("region"), at(-2).alias("nation"), at(-1).alias("customer"), "weight")


@query("SELECT level, count(*) AS n FROM (SELECT 0 AS level UNION ALL SELECT 1 FROM region UNION ALL SELECT 2 FROM nation UNION ALL SELECT 3 FROM customer) GROUP BY 1")
def arc_levels(spark, sf_dir):
    return _graph(spark, sf_dir).order().groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_regionkey::BIGINT + 1 AS src, n_name AS symbol, (n_nationkey % 4)::DOUBLE AS weight FROM nation""")
def relabel_symbols(spark, sf_dir):
    """Arcs of regions to nations, relabelled to a symbol table's numbers, shown as symbols."""
    n = table(spark, sf_dir, "nation")
    pairs = n.select((F.col("n_nationkey") + 100).cast("long").alias("old"), (F.col("n_nationkey") + 9000).cast("long").alias("new"))
    symbols = n.select((F.col("n_nationkey") + 9000).cast("long").alias("olabel"), F.col("n_name").alias("symbol"))
    arcs = _graph(spark, sf_dir).relabel(opairs=pairs).arcs.where("src between 1 and 99")
    return arcs.join(symbols, "olabel").select("src", "symbol", "weight")


@query("SELECT 0::BIGINT AS state, 30::BIGINT AS n_arcs UNION ALL SELECT n_regionkey + 1, count(*) FROM nation GROUP BY 1 UNION ALL SELECT n_nationkey + 100, count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT c_custkey + 1000, 0 FROM customer")
def arc_counts(spark, sf_dir):
    return _graph(spark, sf_dir).counts().select("state", "n_arcs")


@query("SELECT istring, ostring, sum(k)::BIGINT AS n FROM (SELECT user_id::VARCHAR AS istring, event_type AS ostring, 1 AS k FROM events) GROUP BY 1, 2")
def arc_sums(spark, sf_dir):
    """Equal arcs added in the log semiring, as counts."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("istring"), F.col("event_type").alias("ostring"), F.lit(0.0).alias("weight"))
    return Relation(e, "log").merged().df.select("istring", "ostring", F.round(F.exp(-F.col("weight"))).cast("long").alias("n"))


from . import algebra, tables  # noqa: E402,F401  they add their queries to QUERIES and SQL
