"""Keypad texts: words to digits by translation, digits to words by a lexicon join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.native import keypad


def decode(digits: DataFrame, column: str, lexicon: DataFrame, word: str) -> DataFrame:
    """digits' columns and every word that types them."""
    words = lexicon.select(F.col(word).alias("word")).where("word is not null").distinct().withColumn("_keys", keypad(F.col("word")))
    return digits.join(words, F.col(column) == F.col("_keys")).drop("_keys")
