"""Errors, raised while a plan is built wherever that is possible."""


class GrammarError(Exception):
    """Base of all errors of this package."""


class ArgumentError(GrammarError, ValueError):
    """A bad option, type or combination of operands."""


class WeightError(GrammarError, ValueError):
    """A weight that the semiring does not have, or a division by zero."""


class StateIndexError(GrammarError, IndexError):
    """A state that the machine does not have."""


class StorageError(GrammarError, OSError):
    """A file or archive that cannot be read or written."""


class OperationError(GrammarError, ValueError):
    """An operation that is undefined for its operands, such as paths of a cyclic machine."""


class TextCompilationError(GrammarError, ValueError):
    """Text with unbalanced brackets or unknown symbols."""


class RewriteError(GrammarError, ValueError):
    """A rewrite without an output, or with more than the one asked for."""
