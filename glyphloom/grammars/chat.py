"""Chat text normalization: candidates for each token from four sources, and the best sentence by a bigram model.

Sources: doubled letters taken out, abbreviations expanded by vowels put in, patterns, and
a table of expansions.  Candidates that a lexicon holds are joined to the tokens as rows;
the sentence is chosen by a fold over its tokens that keeps the best score of each
candidate, so nothing leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern and replacement (fixed values).
PATTERNS = ((r"\Apl+z+\z", "please"), (r"\Al+o+l+\z", "laughing out loud"), (r"\A(ha){2,}h?\z", "ha ha"), (r"\Ath?x+\z", "thanks"), (r"\Agr8\z", "great"), (r"\Al8r\z", "later"), (r"\Ab4\z", "before"), (r"\Adelish+\z", "delicious"), (r"\Akoo+l\z", "cool"), (r"\Az?omg+z*\z", "oh my god"))


def without_doubles(word: Column) -> Column:
    """Runs of a letter shortened to one."""
    return F.regexp_replace(word, r"([a-z])\1+", "$1")


def with_doubles_at_most_two(word: Column) -> Column:
    return F.regexp_replace(word, r"([a-z])\1{2,}", "$1$1")


def skeleton(word: Column) -> Column:
    """A word's first letter and its consonants: what abbreviations keep."""
    return F.concat(F.substring(word, 1, 1), F.regexp_replace(F.substring(word, 2, 1_000_000), "[aeiou]", ""))


def shortened(word: Column) -> Column:
    """What abbreviations of a word look like: r, l or n left out after a vowel, then spans of vowels between consonants."""
    less = F.regexp_replace(word, "(?<=[aeiou])[rln](?=[^aeiourln])", "")
    spans = lambda w: F.regexp_replace(w, "(?<=[^aeiou])[aeiou]+y?(?=[^aeiou]|$)", "")
    return F.array_distinct(F.array(spans(word), spans(less), skeleton(word)))


def candidates(tokens: DataFrame, token: str, lexicon: DataFrame, word: str, expansions: DataFrame | None = None) -> DataFrame:
    """(token, ostring, weight): distinct tokens' candidates; a token that the lexicon holds costs nothing, other sources 1."""
    own = tokens.select(F.col(token).alias("token")).where("token is not null").distinct()
    words = lexicon.select(F.col(word).alias("word")).where("word is not null").distinct()
    same = own.join(words, F.col("token") == F.col("word")).select("token", F.col("word").alias("ostring"), F.lit(0.0).alias("weight"))
    short = own.withColumn("key", F.explode(F.array_distinct(F.array(without_doubles(F.col("token")), with_doubles_at_most_two(F.col("token"))))))
    single = short.where("key <> token").join(words, F.col("key") == F.col("word")).select("token", F.col("word").alias("ostring"), F.lit(1.0).alias("weight"))
    unknown = own.where(F.length("token") >= 2).join(words, F.col("token") == F.col("word"), "left_anti")
    vowels = unknown.join(words.where(F.length("word") >= 3).withColumn("key", F.explode(shortened(F.col("word")))), (F.col("token") == F.col("key")) & (F.col("token") != F.col("word"))).select("token", F.col("word").alias("ostring"), F.lit(1.0).alias("weight"))
    hit = F.array_compact(F.array(*[F.when(F.col("token").rlike(p), F.lit(r)) for p, r in PATTERNS]))
    pattern = own.select("token", F.explode(hit).alias("ostring"), F.lit(1.0).alias("weight"))
    parts = [same, single, vowels, pattern]
    if expansions is not None:
        table = expansions.select(F.col(expansions.columns[0]).alias("key"), F.col(expansions.columns[1]).alias("ostring"))
        parts.append(own.join(table, F.col("token") == F.col("key")).select("token", "ostring", F.lit(1.0).alias("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    found = out.groupBy("token", "ostring").agg(F.min("weight").alias("weight"))
    rest = own.join(found, "token", "left_anti").select("token", F.col("token").alias("ostring"), F.lit(10.0).alias("weight"))
    return found.unionByName(rest)


def ngram_counts(texts: DataFrame, column: str, n: int) -> DataFrame:
    """(gram array, n) over lower-cased tokens between <s> and </s>; counts are combined before the shuffle."""
    tokens = F.concat(F.array(F.lit("<s>")), F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}']+"), lambda t: t != ""), F.array(F.lit("</s>")))
    rows = texts.where(F.col(column).isNotNull()).select(tokens.alias("t"))
    grams = F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.slice("t", i, n))).otherwise(F.array().cast("array<array<string>>"))
    return rows.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def bigram_model(texts: DataFrame, column: str) -> DataFrame:
    """(first, second, cost): -log of the Witten-Bell probability of seen pairs; `second` null is a pair that was not seen."""
    two = ngram_counts(texts, column, 2).select(F.col("gram")[0].alias("first"), F.col("gram")[1].alias("second"), "n")
    context = two.groupBy("first").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    word = two.groupBy("second").agg(F.sum("n").alias("m"))
    all_n = two.agg(F.sum("n")).scalar()
    p = (F.col("n") + F.col("kinds") * F.col("m") / all_n) / (F.col("total") + F.col("kinds"))
    seen = two.join(context, "first").join(word, "second").select("first", "second", (-F.log(p)).alias("cost"))
    unseen = context.select("first", F.lit(None).cast("string").alias("second"), (-F.log(F.col("kinds") / (F.col("total") + F.col("kinds")))).alias("cost"))
    return seen.unionByName(unseen)


def best_sentences(texts: DataFrame, column: str, found: DataFrame, model: DataFrame, unknown: float = 12.0) -> DataFrame:
    """texts' columns and `normalized`: the least sum of candidates' weights and bigram costs.

    Candidates are joined to the exploded tokens, pairs of neighbours to the model, and each
    row's lattice is solved by one aggregate over its positions.
    """
    # rows alike in all columns get one answer; the key is their content, so a row computed again keeps it
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in texts.columns])))
    second = F.xxhash64(F.lit(7), F.to_json(F.struct(*[F.col(f"`{c}`") for c in texts.columns])))
    keyed = texts.withColumn("_row", F.struct(content.alias("a"), second.alias("b")))
    rows = keyed.dropDuplicates(["_row"])
    tokens = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}']+"), lambda t: t != "")
    placed = rows.select("_row", F.posexplode(tokens).alias("at", "token"))
    options = placed.join(found, "token").select("_row", "at", "ostring", "weight")
    edge = options.select("_row", F.col("at").alias("at2"), F.col("ostring").alias("second"), F.col("weight").alias("w2"))
    pairs = options.withColumn("at2", F.col("at") + 1).join(edge, ["_row", "at2"], "right").select("_row", "at2", F.coalesce("ostring", F.lit("<s>")).alias("first"), "second", "w2")
    seen = model.where("second is not null")
    backoff = model.where("second is null").select("first", F.col("cost").alias("backoff"))
    costed = pairs.join(seen, ["first", "second"], "left").join(backoff, "first", "left")
    cost = F.col("w2") + F.coalesce("cost", F.coalesce("backoff", F.lit(0.0)) + unknown)
    steps = costed.groupBy("_row", "at2").agg(F.collect_list(F.struct("first", "second", cost.alias("cost"))).alias("edges"))
    ordered = steps.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at2", "edges"))).alias("steps"))
    start = F.array(F.struct(F.lit("<s>").alias("word"), F.lit(0.0).alias("total"), F.lit("").alias("text")))

    def advance(state: Column, step: Column) -> Column:
        reach = F.flatten(F.transform(step["edges"], lambda e: F.transform(F.filter(state, lambda s: s["word"] == e["first"]), lambda s: F.struct(e["second"].alias("word"), (s["total"] + e["cost"]).alias("total"), F.concat(s["text"], F.when(s["text"] == "", "").otherwise(" "), e["second"]).alias("text")))))
        words = F.array_distinct(F.transform(reach, lambda r: r["word"]))
        best = lambda w: F.array_min(F.transform(F.filter(reach, lambda r: r["word"] == w), lambda r: F.struct(r["total"].alias("total"), r["text"].alias("text"))))
        return F.transform(words, lambda w: F.struct(w.alias("word"), best(w)["total"].alias("total"), best(w)["text"].alias("text")))

    ends = F.aggregate("steps", start, advance)
    text = F.array_min(F.transform(ends, lambda s: F.struct(s["total"].alias("total"), s["text"].alias("text"))))["text"]
    return keyed.join(ordered.select("_row", text.alias("normalized")), "_row", "left").drop("_row")
