import random

from glyphloom import api
from glyphloom.operators import classes as C
from glyphloom.operators.machine import items
from glyphloom.operators.rules import Acceptor


def test_byte_classes():
    tests = {"DIGIT": str.isdigit, "LOWER": str.islower, "UPPER": str.isupper, "ALPHA": str.isalpha, "ALNUM": str.isalnum, "HEX": lambda c: c in "0123456789abcdefABCDEF", "SPACE": lambda c: c in " \t\n\r", "GRAPH": lambda c: 33 <= ord(c) <= 126, "PUNCT": lambda c: 33 <= ord(c) <= 126 and not c.isalnum()}
    for name, holds in tests.items():
        a = Acceptor(C.byte_class(name))
        assert all(a.accepts_all([x]) == holds(chr(x)) for x in range(1, 128))
    assert not Acceptor(C.byte_class("BYTE")).accepts_all([0])


def test_utf8():
    a, rnd = Acceptor(C.valid_utf8_char()), random.Random(1)
    for p in [1, 0x7F, 0x80, 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF, *[rnd.randrange(0xE000, 0x110000) for _ in range(200)]]:
        assert a.accepts_all(chr(p).encode())
    for _ in range(500):
        raw = bytes(rnd.randrange(1, 256) for _ in range(rnd.randrange(1, 5)))
        try:
            ok = len(raw.decode()) == 1
        except UnicodeDecodeError:
            ok = False
        assert a.accepts_all(raw) == ok
    assert not a.accepts_all([0]) and Acceptor(C.regional_indicator()).accepts_all("\U0001f1e9".encode()) and not Acceptor(C.regional_indicator()).accepts_all("D".encode())


def test_constructions():
    assert items(C.insert("ab", 2)) == [("", "ab", 2.0)] and items(C.delete("ab")) == [("ab", "", 0.0)] and items(C.add_weight("a", 3)) == [("a", "a", 3.0)]
    a = Acceptor(C.join("ab", ","))
    assert a.accepts_all(b"ab") and a.accepts_all(b"ab,ab,ab") and not a.accepts_all(b"ab,") and not a.accepts_all(b"")
    assert api.Fst is type(api.accep("a")) and api.items(api.compose("a", api.cross("a", "b"))) == [("a", "b", 0.0)]
