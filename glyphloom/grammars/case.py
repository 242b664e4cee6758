"""Finnish case endings with vowel harmony."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A stands for a or ä by harmony with the stem.
ENDINGS = {"abessive": "ttA", "ablative": "ltA", "adessive": "llA", "allative": "lle", "elative": "stA", "essive": "nA", "inessive": "ssA"}


def harmonized(stem: Column, ending: str) -> Column:
    """The stem with its ending: back vowels before the end make A an a, otherwise it is ä."""
    vowel = F.when(F.lower(stem).rlike("[aou][^aouäöy]*(?:[ei][^aouäöy]*)*\\z"), "a").otherwise("ä")
    return F.concat(stem, F.replace(F.lit(ending), F.lit("A"), vowel))


def case_of(stem: Column, case: str) -> Column:
    return harmonized(stem, ENDINGS[case])
