"""Character classes and small constructions as machines."""

from __future__ import annotations

from functools import cache

from ..errors import ArgumentError
from ..semiring import TROPICAL
from .machine import Machine, arcmap, closure, concat, machine, minimize, union

#: Ranges of bytes; NUL belongs to none.
BYTE_RANGES = {
    "BYTE": [(1, 255)], "DIGIT": [(48, 57)], "LOWER": [(97, 122)], "UPPER": [(65, 90)], "ALPHA": [(65, 90), (97, 122)],
    "ALNUM": [(48, 57), (65, 90), (97, 122)], "HEX": [(48, 57), (65, 70), (97, 102)], "SPACE": [(9, 10), (13, 13), (32, 32)],
    "NOT_SPACE": [(1, 8), (11, 12), (14, 31), (33, 255)], "NOT_QUOTE": [(1, 33), (35, 255)],
    "PUNCT": [(33, 47), (58, 64), (91, 96), (123, 126)], "GRAPH": [(33, 126)],
    "SINGLE_BYTE": [(1, 127)], "LEADING_BYTE": [(0xC2, 0xF4)], "CONTINUATION_BYTE": [(0x80, 0xBF)], "VALID_BYTE": [(1, 0xBF), (0xC2, 0xF4)],
}

#: The byte sequences of well-formed UTF-8 (RFC 3629), without NUL.
UTF8_SEQUENCES = (
    ((1, 0x7F),), ((0xC2, 0xDF), (0x80, 0xBF)), ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)), ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)), ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)), ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)), ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)),
)
REGIONAL_INDICATOR = ((0xF0, 0xF0), (0x9F, 0x9F), (0x87, 0x87), (0xA6, 0xBF))


def of_ranges(ranges) -> Machine:
    """One label out of the ranges."""
    m = Machine(TROPICAL)
    m.add_states(2)
    m.set_start(0).set_final(1)
    for low, high in ranges:
        for x in range(low, high + 1):
            m.add_arc(0, x, x, None, 1)
    return m


@cache
def byte_class(name: str) -> Machine:
    if name not in BYTE_RANGES:
        raise ArgumentError(f"unknown class: {name}")
    return of_ranges(BYTE_RANGES[name])


@cache
def valid_utf8_char() -> Machine:
    return minimize(union(*[concat(*[of_ranges([r]) for r in s]) if len(s) > 1 else of_ranges(s) for s in UTF8_SEQUENCES]))


@cache
def regional_indicator() -> Machine:
    return concat(*[of_ranges([r]) for r in REGIONAL_INDICATOR])


# ---------------------------------------------------------------- small constructions


def add_weight(x, weight) -> Machine:
    x = machine(x)
    out = x.copy()
    for s, w in x.finals.items():
        out.set_final(s, x.semiring.times(w, x.semiring.weight(weight)))
    return out


def insert(x, weight=None) -> Machine:
    """Nothing to x."""
    out = arcmap(x, "input_epsilon")
    return out if weight is None else add_weight(out, weight)


def delete(x, weight=None) -> Machine:
    """x to nothing."""
    out = arcmap(x, "output_epsilon")
    return out if weight is None else add_weight(out, weight)


def join(x, separator) -> Machine:
    """x (separator x)*"""
    return concat(x, closure(concat(machine(separator), machine(x))))
