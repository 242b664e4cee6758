"""Rewrite rules as column expressions, for rules whose outcome is the same for every reading.

A literal rule replaces one string by another between contexts of fixed text.  With the
left context tested on the input (`sim`) that is one regular expression; tested on the
output (`ltr`) it is a fold over the places where it may apply, and `rtl` is the fold from the end.  The
searched string must not overlap itself, or several derivations would exist; those rules
belong to operators.rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError

#: Boundary marks in contexts.
BOS, EOS = "[BOS]", "[EOS]"


def regex_quoted(text: str) -> str:
    """Text as a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", text)


def overlaps_itself(text: str) -> bool:
    return any(text.endswith(text[:k]) for k in range(1, len(text)))


def _context(text: str) -> tuple[str, bool, bool]:
    """(text, at the start?, at the end?)"""
    begins, ends = text.startswith(BOS), text.endswith(EOS)
    return text.removeprefix(BOS).removesuffix(EOS), begins, ends


def is_native(phi: str, psi: str, left: str = "", right: str = "", direction: str = "sim", mode: str = "obl") -> bool:
    """Whether `literal_rule` can express the rule."""
    return mode == "obl" and bool(phi) and not overlaps_itself(phi) and direction in ("sim", "ltr", "rtl")


def literal_rule(c: Column, phi: str, psi: str, left: str = "", right: str = "", direction: str = "sim") -> Column:
    """phi to psi / left __ right, obligatory."""
    if not is_native(phi, psi, left, right, direction):
        raise ArgumentError("the rule has no unique native form")
    (l, l_start, _), (r, _, r_end) = _context(left), _context(right)
    if direction == "sim":
        before = "(?<=" + (r"\A" if l_start else "") + regex_quoted(l) + ")" if l or l_start else ""
        after = "(?=" + regex_quoted(r) + (r"\z" if r_end else "") + ")" if r or r_end else ""
        return F.regexp_replace(c, before + regex_quoted(phi) + after, re.sub(r"([\\$])", r"\\\1", psi))
    if direction == "rtl":
        flip = lambda s: s[::-1]
        return F.reverse(_fold(F.reverse(c), flip(phi), flip(psi), flip(r), flip(l), r_end, l_start))
    return _fold(c, phi, psi, l, r, l_start, r_end)


def _fold(c: Column, phi: str, psi: str, left: str, right: str, at_start: bool, at_end: bool) -> Column:
    """Left to right: the output so far decides the left context, the input the right one.

    phi does not overlap itself, so a split at its occurrences before the right context finds
    every site; the fold takes one step a site, not one a character.
    """
    after = "(?=" + regex_quoted(right) + (r"\z" if at_end else "") + ")" if right or at_end else ""
    pieces = F.split(c, regex_quoted(phi) + after, -1)

    def step(out: Column, piece: Column) -> Column:
        fits = (out == left) if at_start else out.endswith(F.lit(left))
        return F.concat(out, F.when(fits, F.lit(psi)).otherwise(F.lit(phi)), piece)

    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.element_at(pieces, 1), step)


def cascade(c: Column, *steps) -> Column:
    """Expressions applied one after the other."""
    for step in steps:
        c = step(c)
    return c


def in_alphabet(c: Column, characters: str) -> Column:
    """Whether a string is made of these characters only."""
    return c.rlike(r"\A[" + regex_quoted(characters) + r"]*\z")


def within(c: Column, characters: str, strict: bool = False) -> Column:
    """The string, or null (or an error) if it leaves the alphabet."""
    bad = F.raise_error(F.concat(F.lit("outside of the alphabet: "), c)) if strict else F.lit(None).cast("string")
    return F.when(in_alphabet(c, characters), c).otherwise(bad)


# ---------------------------------------------------------------- single columns as relations


def insert(c: Column, text: str) -> Column:
    return F.concat(c, F.lit(text))


def delete(c: Column, text: str) -> Column:
    return F.regexp_replace(c, regex_quoted(text), "")


def join_of(c: Column, word_regex: str, separator: str) -> Column:
    """Is the string expr (separator expr)*?"""
    return c.rlike(rf"\A(?:{word_regex})(?:{regex_quoted(separator)}(?:{word_regex}))*\z")


def repeated(c: Column, word_regex: str, lower: int, upper: int | None = None) -> Column:
    """Is the string `lower` to `upper` repetitions?"""
    if lower < 0 or upper is not None and upper < lower:
        raise ArgumentError(f"no range of repetitions: {lower} to {upper}")
    return c.rlike(rf"\A(?:{word_regex}){{{lower},{'' if upper is None else upper}}}\z")


def escape(c: Column) -> Column:
    """Brackets and backslashes escaped."""
    return F.regexp_replace(c, r"([\[\]\\])", r"\\$1")


def tag_terms(c: Column, lexicon: list[str], tag: str) -> Column:
    """Every occurrence of a term, longest first, in <tag>...</tag>; terms that are no parts of each other."""
    for a in lexicon:
        if any(a != b and a in b for b in lexicon):
            raise ArgumentError(f"{a!r} is part of another term; use grammars.tagger")
    any_term = "|".join(regex_quoted(t) for t in sorted(lexicon, key=lambda t: (-len(t), t)))
    return F.regexp_replace(c, f"({any_term})", f"<{tag}>$1</{tag}>")


# ---------------------------------------------------------------- character classes

#: ASCII classes as regular-expression sets; NUL belongs to none.
CLASSES = {
    "BYTE": r"\x01-\x{FF}", "DIGIT": "0-9", "LOWER": "a-z", "UPPER": "A-Z", "ALPHA": "A-Za-z", "ALNUM": "0-9A-Za-z", "HEX": "0-9A-Fa-f",
    "SPACE": r" \t\n\r", "NOT_SPACE": r"\x01-\x08\x0B\x0C\x0E-\x1F\x21-\x{FF}", "NOT_QUOTE": r"\x01-\x21\x23-\x{FF}",
    "PUNCT": r"!-/:-@\[-`{-~", "GRAPH": "!-~",
}


def all_of(c: Column, name: str) -> Column:
    """Do all characters (bytes, for text decoded as latin-1) belong to the class?"""
    return c.rlike(rf"\A[{CLASSES[name]}]*\z")


def count_of(c: Column, name: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"[{CLASSES[name]}]", ""))


def is_valid_utf8(c: Column) -> Column:
    """Well-formed UTF-8 without NUL."""
    raw = c.cast("binary")
    return F.is_valid_utf8(raw) & ~F.hex(raw).rlike(r"\A(..)*00")


def utf8_lead(c: Column) -> Column:
    """Numbers of single bytes, leading bytes and continuation bytes of a binary or string column."""
    hexed = F.hex(c.cast("binary"))
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))
    return F.struct(
        F.size(F.filter(pairs, lambda p: (p >= "01") & (p <= "7F"))).alias("single"),
        F.size(F.filter(pairs, lambda p: (p >= "C2") & (p <= "F4"))).alias("leading"),
        F.size(F.filter(pairs, lambda p: (p >= "80") & (p <= "BF"))).alias("continuation"),
    )


def is_regional_indicator(c: Column) -> Column:
    return c.rlike(r"\A[\x{1F1E6}-\x{1F1FF}]\z")


# ---------------------------------------------------------------- keypad

KEYS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999"


def keypad(c: Column) -> Column:
    """The digits that type a text."""
    return F.translate(F.lower(c), KEYS, DIGITS)


# ---------------------------------------------------------------- edit distance


def edit_distance(a: Column, b: Column, bound: int = 0, by_bytes: bool = False) -> Column:
    """Unit-cost distance; null above a bound (0: none).  Characters are code points, or bytes of UTF-8."""
    if by_bytes:
        a, b = (F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b))
    if not bound:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, bound)
    return F.when(d >= 0, d)
