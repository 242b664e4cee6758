"""Tags around lexicon terms; overlapping terms go to the longest, leftmost first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.native import regex_quoted, within


@dataclass(frozen=True)
class Tagger:
    """Wraps every match in <tag>...</tag>; text outside of the alphabet gives null, or an error if strict."""

    tag: str
    lexicon: tuple[str, ...]
    alphabet: str | None = None
    strict: bool = False

    def __post_init__(self):
        if not self.lexicon or not all(self.lexicon):
            raise ArgumentError("a lexicon of nonempty terms")

    def apply(self, text: Column) -> Column:
        terms = "|".join(regex_quoted(t) for t in sorted(set(self.lexicon), key=lambda t: (-len(t), t)))
        out = F.regexp_replace(text, f"({terms})", f"<{self.tag}>$1</{self.tag}>")
        return out if self.alphabet is None else F.when(within(text, self.alphabet, self.strict).isNotNull(), out)
