"""Dates in text, tagged: <date><month>1</month><day>2</day><year>1985</year></date>.

Forms: a month's name with a day ("January 2", "January the 2nd"), a day with a month's name
("2 January", "the 2nd of January"), both with or without a year; a month's name with a
year; year/month/day and day/month/year in numbers.  Names are read in any case and become
numbers; a day loses its leading zero; the order of the text is kept.  Where readings
compete, the leftmost wins, of those the one with a year in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
SHORT = {"september": ("sept", "sep")}

_NAMES = "|".join(f"{m}|" + "|".join(f"{s}\\.?" for s in SHORT.get(m, (m[:3],))) for m in MONTHS).replace("may|may\\.?", "may")
_NAME = rf"({_NAMES})(?![a-z])"
_DAY = r"0?([1-9]|[12][0-9]|3[01])(?![0-9])"
_ORDINAL = r"0?([123]?1(?=st)|[12]?2(?=nd)|[12]?3(?=rd)|(?:[12]?[4-9]|[123]0|1[123])(?=th))(?:st|nd|rd|th)\b"
_YEAR = r"([1-9][0-9]{3})(?![0-9])"
_TAIL = rf"(?:,? +{_YEAR})?"
_BEFORE = r"(?i)(?<![0-9A-Za-z/])"

#: Pattern and the tags of its groups; a name group takes the month's number.
FORMS = (
    (rf"{_NAME} +(?:the +)?{_ORDINAL}{_TAIL}", ("name", "day", "year")),
    (rf"{_NAME} +{_DAY}{_TAIL}", ("name", "day", "year")),
    (rf"(?:the +)?{_ORDINAL} +of +{_NAME}{_TAIL}", ("day", "name", "year")),
    (rf"{_DAY} +{_NAME}{_TAIL}", ("day", "name", "year")),
    (rf"{_NAME} +{_YEAR}", ("name", "year")),
    (rf"{_YEAR}/([1-9]|1[0-2])/{_DAY}(?!/)", ("year", "month", "day")),
    (rf"{_DAY}/([1-9]|1[0-2])/{_YEAR}(?!/)", ("day", "month", "year")),
)


def _groups() -> list[tuple[int, tuple[str, ...]]]:
    """For each form the number of its first group in the union of all."""
    out, first = [], 1
    for _, tags in FORMS:
        out.append((first, tags))
        first += len(tags)
    return out


def tag_dates(text: Column) -> Column:
    """The text with its dates tagged.

    One pass marks the dates of all forms, each group between characters that text does not
    hold; month names are numbered between these marks only.
    """
    marked = "".join("".join(f"\ue000{t[0]}${first + k}\ue001" for k, t in enumerate(tags)) for first, tags in _groups())
    out = F.regexp_replace(text, _BEFORE + "(?:" + "|".join(p for p, _ in FORMS) + ")", f"<date>{marked}</date>")
    out = F.regexp_replace(out, "\ue000[a-z]\ue001", "")
    for number, m in enumerate(MONTHS, 1):
        out = F.regexp_replace(out, rf"(?i)\ue000n(?:{m}|{'|'.join(SHORT.get(m, (m[:3],)))})\.?\ue001", f"<month>{number}</month>")
    for tag in ("day", "month", "year"):
        out = F.regexp_replace(out, f"\ue000{tag[0]}([0-9]+)\ue001", f"<{tag}>$1</{tag}>")
    return out
