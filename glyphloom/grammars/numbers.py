"""English names of the numbers 1 to 9,999,999."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _below_thousand(n: Column) -> Column:
    """Words of 1 to 999; null for 0, which concat_ws skips."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    rest = (n % 100).cast("int")
    hundreds = F.when(n >= 100, F.concat(F.element_at(ones, F.floor(n / 100).cast("int")), F.lit(" hundred")))
    small = F.when((rest >= 1) & (rest < 20), F.element_at(ones, rest))
    ten = F.when(rest >= 20, F.element_at(tens, (F.floor(rest / 10) - 1).cast("int")))
    one = F.when((rest >= 20) & (rest % 10 > 0), F.element_at(ones, (rest % 10).cast("int")))
    return F.when(n > 0, F.concat_ws(" ", hundreds, small, ten, one))


def number_name(n: Column) -> Column:
    """The name; null outside of 1 to 9,999,999 (zero has none, and there are seven digits)."""
    part = lambda d: F.floor(n / d) % 1000
    with_unit = lambda words, unit: F.when(words.isNotNull(), F.concat(words, F.lit(unit)))
    words = F.concat_ws(" ", with_unit(_below_thousand(part(1_000_000)), " million"), with_unit(_below_thousand(part(1000)), " thousand"), _below_thousand(part(1)))
    return F.when((n >= 1) & (n <= 9_999_999), words)
