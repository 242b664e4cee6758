"""Rules on streams.

Native rules, joins with a static lexicon and the kernel keep no state between rows, so the
same functions run on a streaming DataFrame unchanged.  Windowed counts of outputs take a
watermark, after which late rows are dropped and state is freed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.apply import rewrite
from ..plans.choose import LiteralRule, apply_rules


def rewrite_stream(stream: DataFrame, column: str, rules, to: str = "output", sigma_star=None) -> DataFrame:
    """A list of LiteralRule, or one compiled rule."""
    if isinstance(rules, list) and all(isinstance(r, LiteralRule) for r in rules):
        return apply_rules(stream, column, rules, to, sigma_star)
    return rewrite(stream, column, rules, to)


def counts_by_window(stream: DataFrame, time: str, output: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window, output, n."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), output).agg(F.count(F.lit(1)).alias("n"))
