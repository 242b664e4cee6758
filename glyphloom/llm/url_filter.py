"""URL filter: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models over characters, one of the urls that rules allow and one
of those that they block, are fitted on three of four such urls.  A character's
probability after its last two characters is interpolated down to one, none, and uniform
(Witten-Bell: a context counts as often as it was seen, the shorter one as often as
different characters followed it).  A url's score is the mean, over its characters and its
end, of the difference of log-probabilities.  The cutoff is calibrated on the fourth url
of four: the largest of a thousandth's steps below which lie at most `lost_percent` of the
allowed ones.  Urls without a rule are blocked below it.  The models read whole urls, with
scheme, query and fragment.

Everything is DataFrame operations.  Characters are folded to 40 symbols, so the models
together are one array of 40**3 numbers whatever the input; it goes to the scan as a
scalar subquery, and scoring needs neither join nor shuffle.

A null url, or one without "://", has empty host and path and fits no rule; null is scored
as the empty string.  If no url was allowed, or none blocked, the method allows.  Rows are
judged by their url alone, so repeated rows and ties do not matter.  Only the id and url
columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import checkpointed

#: Folding of characters: place in the string; 0 is before the start and after the end, 39 any other.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-./_%=&~+:@"
SYMBOLS = 40
OTHER = SYMBOLS - 1
FIRST_PRIVATE = 0xE000
_PRIVATE = [chr(FIRST_PRIVATE + 1 + k) for k in range(len(ALPHABET))]
STEP = 1000


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as its text; at most 200 rules."""
    if len(rules) > 200:
        raise ValueError("at most 200 rules")
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r.text).otherwise(out)
    return out


def codes_of(text: Column) -> Column:
    """The symbols of a text, A-Z lower-cased and digits alike, with boundaries around: two before, one after."""
    # each symbol's character becomes one of a private range, whose code point tells its number
    folded = F.translate(text, UPPER + "123456789" + ALPHABET + "".join(_PRIVATE), "".join(_PRIVATE[ALPHABET.index(c)] for c in UPPER.lower() + "0" * 9 + ALPHABET) + "!" * len(_PRIVATE))
    one = lambda c: F.when(F.ascii(c).between(FIRST_PRIVATE + 1, FIRST_PRIVATE + len(ALPHABET)), F.ascii(c) - FIRST_PRIVATE).otherwise(F.lit(OTHER))
    inner = F.when(F.length(folded) > 0, F.transform(F.split(folded, ""), one)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0), F.lit(0)), inner, F.array(F.lit(0)))


def _grams(codes: Column) -> Column:
    """The number of each symbol together with the two before it."""
    at = lambda i: F.element_at(codes, i)
    return F.transform(F.sequence(F.lit(3), F.size(codes)), lambda i: at(i - 2) * SYMBOLS**2 + at(i - 1) * SYMBOLS + at(i))


def _model(counted: DataFrame) -> DataFrame:
    """(gram, log_ratio) of all SYMBOLS**3 grams from (kind, gram, n); kind is allow or block."""
    every = counted.sparkSession.range(SYMBOLS**3).select(F.col("id").alias("gram"))
    a, b, c = (F.floor(F.col("gram") / SYMBOLS**2), F.floor(F.col("gram") / SYMBOLS) % SYMBOLS, F.col("gram") % SYMBOLS)
    every = every.select("gram", a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    n = counted.groupBy("gram").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ("allow", "block")])
    grid = every.join(F.broadcast(n), "gram", "left").na.fill(0)  # n has at most SYMBOLS**3 rows
    out = {}
    level = grid
    for k in ("allow", "block"):
        # totals and numbers of different followers: of two characters, of one, of none
        one = grid.groupBy("b", "c").agg(F.sum(f"n_{k}").alias("n"))
        none = one.groupBy("c").agg(F.sum("n").alias("n"))
        follow = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("all"), F.count_if(F.col("n") > 0).alias("kinds"))
        two_all = follow(grid.withColumn("n", F.col(f"n_{k}")), "a", "b").toDF("a", "b", f"{k}_all2", f"{k}_kinds2")
        one_all = follow(one, "b").toDF("b", f"{k}_all1", f"{k}_kinds1")
        level = (
            level.join(F.broadcast(two_all), ["a", "b"]).join(F.broadcast(one_all), "b").join(F.broadcast(one.toDF("b", "c", f"{k}_n1")), ["b", "c"])
            .join(F.broadcast(none.toDF("c", f"{k}_n0")), "c")
            .withColumn(f"{k}_all0", none.agg(F.sum("n")).scalar()).withColumn(f"{k}_kinds0", none.agg(F.count_if(F.col("n") > 0)).scalar())
        )
        p = F.lit(1.0 / SYMBOLS)
        for m, count in ((0, f"{k}_n0"), (1, f"{k}_n1"), (2, f"n_{k}")):
            seen, kinds = F.col(f"{k}_all{m}"), F.col(f"{k}_kinds{m}")
            p = F.when(seen > 0, (F.col(count) + kinds * p) / (seen + kinds)).otherwise(p)
        out[k] = p
    return level.select("gram", (F.log(out["allow"]) - F.log(out["block"])).alias("log_ratio"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, lost_percent: int = 5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict, and the method's score in thousandths, for each row."""
    url = F.col(f"`{url_col}`").cast("string")
    judged = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url, F.lit("")).alias("text"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("by_rule", F.when(F.col("rule").isin([r.text for r in rules if r.verdict == "allow"]), "allow").when(F.col("rule").isNotNull(), "block"))
    judged = judged.withColumn("kept_back", F.substring(F.md5("text"), 1, 1).isin("0", "1", "2", "3"))
    # codes are a column of their own: within a lambda they would be made anew for every symbol
    grams = judged.withColumn("codes", codes_of(F.col("text"))).withColumn("grams", _grams(F.col("codes"))).drop("codes", "text")

    taught = grams.where("by_rule is not null and not kept_back").select(F.col("by_rule").alias("kind"), F.explode("grams").alias("gram"))
    counted = checkpointed(taught.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n")))
    table = _model(counted).agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "log_ratio"))), lambda x: x["log_ratio"]).alias("ratios"))
    table = checkpointed(table)
    mean = F.aggregate("grams", F.lit(0.0), lambda total, g: total + F.element_at(F.col("ratios"), (g + 1).cast("int"))) / F.size("grams")
    scored = grams.withColumn("ratios", table.scalar()).withColumn("score", F.floor(mean * STEP).cast("long")).drop("ratios", "grams")

    good = scored.where("by_rule = 'allow' and kept_back").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # scores are thousandths of a bounded mean: some tens of thousands of rows at most, whatever the input
    ranked = good.agg(F.array_sort(F.collect_list(F.struct("score", "n"))).alias("steps"), F.sum("n").alias("total"))
    below = lambda s: F.aggregate(F.filter("steps", lambda x: x["score"] < s), F.lit(0).cast("long"), lambda t, x: t + x["n"])
    cutoff = ranked.select(F.array_max(F.transform(F.filter("steps", lambda x: below(x["score"]) * 100 <= lost_percent * F.col("total")), lambda x: x["score"])).alias("cutoff"))
    both = counted.agg(F.count_distinct("kind").alias("kinds")).scalar()
    by_method = F.when((both == 2) & (F.col("score") < cutoff.scalar()), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "score")
