"""Text to labels and back.

In byte and utf8 mode a character is a label, and [x] a symbol: a number in C notation, a
single byte, or a name that gets a label of its own the first time it is met; [x y z] are
several names.  \\[ \\] \\\\ \\n \\r \\t are escapes.  A SymbolTable splits text at single
spaces.  Labels for names are given out on the driver only.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from .errors import ArgumentError, TextCompilationError

EPSILON = 0
#: Labels of the boundary marks and of the first generated name.
BOS, EOS, FIRST_GENERATED = 0xF8FE, 0xF8FF, 0xF0000

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "[": "[", "]": "]", "\\": "\\"}


class SymbolTable:
    """A two-way table of labels and symbols."""

    def __init__(self, name: str = "", pairs=()):
        self.name, self._label, self._symbol = name, {}, {}
        for label, symbol in pairs:
            self.add_symbol(symbol, label)

    def add_symbol(self, symbol: str, label: int | None = None) -> int:
        if symbol in self._label:
            return self._label[symbol]
        label = self.available_key() if label is None else label
        self._label[symbol], self._symbol[label] = label, symbol
        return label

    def add_table(self, other: SymbolTable) -> None:
        for _, symbol in other:
            self.add_symbol(symbol)

    def find(self, key: int | str) -> str | int:
        """Symbol of a label ('' if none) or label of a symbol (-1 if none)."""
        return self._symbol.get(key, "") if isinstance(key, int) else self._label.get(key, -1)

    def member(self, key: int | str) -> bool:
        return key in (self._symbol if isinstance(key, int) else self._label)

    __contains__ = member

    def get_nth_key(self, n: int) -> int:
        keys = list(self._symbol)
        return keys[n] if 0 <= n < len(keys) else -1

    def available_key(self) -> int:
        return max(self._symbol, default=-1) + 1

    def num_symbols(self) -> int:
        return len(self._symbol)

    __len__ = num_symbols

    def __iter__(self):
        return iter(list(self._symbol.items()))

    def copy(self) -> SymbolTable:
        return SymbolTable(self.name, self)

    def set_name(self, name: str) -> None:
        self.name = name

    def checksum(self) -> str:
        """Of the symbols in order; labeled_checksum also of their labels."""
        import hashlib

        return hashlib.md5("\0".join(s for _, s in self).encode()).hexdigest()

    def labeled_checksum(self) -> str:
        import hashlib

        return hashlib.md5("\0".join(f"{k}\1{s}" for k, s in sorted(self)).encode()).hexdigest()

    def compacted(self) -> SymbolTable:
        """The same symbols with labels 0, 1, 2, ... in order."""
        return SymbolTable(self.name, enumerate(s for _, s in sorted(self)))

    def merged(self, other: SymbolTable) -> SymbolTable:
        """Both tables' symbols; this one's labels win."""
        out = self.copy()
        for label, symbol in other:
            if symbol not in out:
                out.add_symbol(symbol, None if label in out else label)
        return out

    def to_bytes(self) -> bytes:
        import json

        return json.dumps([self.name, list(self)]).encode()

    @classmethod
    def of_bytes(cls, data: bytes) -> SymbolTable:
        import json

        try:
            name, pairs = json.loads(data)
            return cls(name, pairs)
        except (ValueError, TypeError) as e:
            raise ArgumentError("not the bytes of a symbol table") from e

    def frame(self, spark):
        return spark.createDataFrame(list(self), "id long, symbol string")

    @classmethod
    def of_frame(cls, df, name: str = "") -> SymbolTable:
        return cls(name, [(r.id, r.symbol) for r in df.orderBy("id").collect()])


#: Names that were given labels in this session.
GENERATED = SymbolTable("generated", [(BOS, "BOS"), (EOS, "EOS")])


def generated_symbols() -> SymbolTable:
    return GENERATED.copy()


def label_of_name(name: str) -> int:
    if name not in GENERATED:
        GENERATED.add_symbol(name, max(FIRST_GENERATED, max((k for k, _ in GENERATED if k >= FIRST_GENERATED), default=FIRST_GENERATED - 1) + 1))
    return GENERATED.find(name)


def merge_generated(other: SymbolTable) -> dict[int, int]:
    """New labels for the names of another session's table."""
    return {label: label_of_name(name) for label, name in other if label >= FIRST_GENERATED and label != label_of_name(name)}


_token_types: list = ["byte"]


def token_type(given=None):
    kind = given if given is not None else _token_types[-1]
    if kind not in ("byte", "utf8") and not isinstance(kind, SymbolTable):
        raise ArgumentError(f"unknown token type: {kind!r}")
    return kind


@contextmanager
def default_token_type(kind):
    """A context manager, and a decorator, within which `kind` is the default."""
    _token_types.append(token_type(kind))
    try:
        yield
    finally:
        _token_types.pop()


def escape(text: str) -> str:
    return re.sub(r"([\[\]\\])", r"\\\1", text)


def _number(token: str) -> int | None:
    if re.fullmatch(r"-?0[xX][0-9a-fA-F]+", token):
        return int(token, 16)
    if re.fullmatch(r"-?0[0-7]*", token):
        return int(token, 8)
    return int(token) if re.fullmatch(r"-?[1-9][0-9]*", token) else None


def _characters(text: str, kind: str) -> list[int]:
    return list(text.encode()) if kind == "byte" else [ord(c) for c in text]


def to_labels(text: str, kind=None) -> list[int]:
    kind = token_type(kind)
    if isinstance(kind, SymbolTable):
        missing = [s for s in text.split(" ") if text and s not in kind]
        if missing:
            raise TextCompilationError(f"unknown symbol: {missing[0]}")
        return [kind.find(s) for s in text.split(" ")] if text else []
    out, inside, i = [], None, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in _ESCAPES:
            c, i = _ESCAPES[text[i + 1]], i + 1
            if inside is None:
                out += _characters(c, kind)
            else:
                inside += c
        elif c == "[":
            if inside is not None:
                raise TextCompilationError(f"bracket within brackets: {text}")
            inside = ""
        elif c == "]":
            if inside is None:
                raise TextCompilationError(f"bracket closed but not opened: {text}")
            names = inside.split()
            if not names:
                raise TextCompilationError(f"empty brackets: {text}")
            number = _number(names[0]) if len(names) == 1 else None
            out += [number] if number is not None else [ord(n) if len(n) == 1 and ord(n) < 256 else label_of_name(n) for n in names]
            inside = None
        elif inside is None:
            out += _characters(c, kind)
        else:
            inside += c
        i += 1
    if inside is not None:
        raise TextCompilationError(f"bracket opened but not closed: {text}")
    return [x for x in out if x != EPSILON]


def to_text(labels, kind=None) -> str:
    """Labels as text; labels above characters print as [name]."""
    kind = token_type(kind)
    labels = [x for x in labels if x != EPSILON]
    if isinstance(kind, SymbolTable):
        return " ".join(kind.find(x) for x in labels)
    parts, raw = [], bytearray()
    for x in labels:
        if x in GENERATED and x >= 256:
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            parts.append(f"[{GENERATED.find(x)}]")
        elif kind == "utf8":
            raw += chr(x).encode()
        elif x < 256:
            raw.append(x)
        else:
            raise TextCompilationError(f"no character has label {x}")
    return "".join(parts) + raw.decode("utf-8", "replace")
