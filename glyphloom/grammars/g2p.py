"""Spanish spelling to sounds by ordered rules, each one regular expression; words outside of the alphabet give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnñopqrstuvwxyzáéíóúü"

#: Letters and pairs that sound the same everywhere, longer ones first.
PAIRS = (("ch", "tʃ"), ("ll", "ʝ"), ("qu", "k"))
SINGLES = ("jñvxyáéíóúü", "xɲbsjaeiouw")


def sounds(word: Column) -> Column:
    """Pairs and single letters, silent h, r between vowels, rr, soft c and g, hard c.

    A tap needs vowels on both sides; the vowels may have lost their accents or an h by then.
    """
    out = word
    for pair, sound in PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(sound))
    out = F.translate(out, *SINGLES)
    out = F.replace(out, F.lit("h"), F.lit(""))
    for pattern, sound in (("(?<=[aeiou])r(?=[aeiou])", "ɾ"), ("rr", "r"), ("c(?=[ie])", "s"), ("g(?=[ie])", "x"), ("c", "k")):
        out = F.regexp_replace(out, pattern, sound)
    return F.when(word.rlike(rf"\A[{LETTERS}]*\z"), out)
