"""The physical form of a rule on a column: a native expression where it has a unique reading, else the kernel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.native import is_native, literal_rule
from ..labels import escape
from ..operators.apply import rewrite
from ..operators.machine import cross
from ..operators.rules import RewriteRule, cdrewrite


@dataclass(frozen=True)
class LiteralRule:
    """phi to psi / left __ right; contexts may start with [BOS] or end with [EOS]."""

    phi: str
    psi: str
    left: str = ""
    right: str = ""
    direction: str = "ltr"
    mode: str = "obl"

    @property
    def native(self) -> bool:
        return is_native(self.phi, self.psi, self.left, self.right, self.direction, self.mode)

    def compiled(self, sigma_star) -> RewriteRule:
        quoted = lambda c: c if c.startswith("[BOS]") or c.endswith("[EOS]") else escape(c)
        return cdrewrite(cross(escape(self.phi), escape(self.psi)), quoted(self.left), quoted(self.right), sigma_star, self.direction, self.mode)


def apply_rules(df: DataFrame, column: str, rules: list[LiteralRule], to: str, sigma_star=None) -> DataFrame:
    """Rules in order; runs of native ones become one projection, others go through the kernel one by one."""
    out, expression = df, F.col(column)
    for rule in rules:
        if rule.native:
            expression = literal_rule(expression, rule.phi, rule.psi, rule.left, rule.right, rule.direction)
            continue
        out = rewrite(out.withColumn(to, expression), to, rule.compiled(sigma_star), "_next", "top", token_type="utf8").drop(to).withColumnRenamed("_next", to)
        expression = F.col(to)
    return out.withColumn(to, expression)
