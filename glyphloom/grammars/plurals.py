"""English plurals: a table of the caller's own first, then the nouns that change inside or not at all, then rules by ending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nouns of closed classes, each with all of its common members.
UNCHANGED = "aircraft bison cod deer fish means moose offspring salmon series sheep species swine trout".split()
OTHER_VOWEL = {"foot": "feet", "goose": "geese", "louse": "lice", "man": "men", "mouse": "mice", "tooth": "teeth", "woman": "women"}
OLD_ENDING = {"child": "children", "ox": "oxen", "person": "people"}
VOICED = "calf elf half hoof knife leaf life loaf scarf self sheaf shelf thief wharf wife wolf".split()
FOREIGN_ON = "criterion phenomenon".split()


def by_rule(word: Column) -> Column:
    """-ies after a consonant and y, -es for -is, -ves for voiced ends, -es after a hiss, else -s."""
    return (
        F.when(word.rlike(r"([^aeiou]|qu)y\z"), F.concat(F.regexp_replace(word, r"y\z", ""), F.lit("ies")))
        .when(word.rlike(r"[sx]is\z"), F.regexp_replace(word, r"is\z", "es"))
        .when(word.isin(*VOICED), F.concat(F.regexp_replace(word, r"fe?\z", ""), F.lit("ves")))
        .when(word.isin(*FOREIGN_ON), F.regexp_replace(word, r"on\z", "a"))
        .when(word.rlike(r"(s|x|z|ch|sh)\z"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def plural(word: Column, exceptions: dict[str, str] | None = None) -> Column:
    """Priority union: the caller's exceptions, the closed classes, the rules."""
    known = {w: w for w in UNCHANGED} | OTHER_VOWEL | OLD_ENDING | (exceptions or {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(table, word), by_rule(word))


def singular_count(n: Column, word: Column) -> Column:
    """`1 word` or `n words`."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, word).otherwise(plural(word)))
