"""Errors of the store."""


class StoreError(Exception):
    """Base of all errors raised by this library."""


class StoreIOError(StoreError):
    """A file operation failed."""


class CorruptError(StoreError):
    """Stored bytes do not match their checksum or shape."""


class TornError(CorruptError):
    """A file is shorter than its header says: its writing was cut off."""


class BadFormatError(StoreError):
    """A file was written by a format this version does not know."""


class LockedError(StoreError):
    """Another handle has the directory open."""


class PoisonedError(StoreError):
    """An earlier flush or compaction failed; reopen the store."""
