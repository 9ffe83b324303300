"""Errors of grid tables."""


class GridError(Exception):
    """Base of all errors here."""


class Invalid(GridError):
    """An argument or input that breaks a rule."""


class InvalidState(GridError):
    """An operation that the table's present state does not admit."""


class NotFound(GridError):
    """A table, partition or column that does not exist."""


class KeyMissing(NotFound):
    """A (sym, time) to be overwritten that the table does not hold."""


class AlreadyExists(GridError):
    """A table, partition or column that exists already."""


class NonContiguousTime(GridError):
    """A symbol whose times are no contiguous part of its partition's time axis."""


class Format(GridError):
    """A manifest or data file that can't be read as what it should be."""


class Codec(Invalid):
    """A compression that is not known, or that the data don't bear."""


class Io(GridError):
    """A file system that failed."""
