"""What a store raises."""

from __future__ import annotations

from collections import Counter

#: Errors raised so far, by class name.
COUNTS: Counter[str] = Counter()


class StoreError(Exception):
    """Base of all; counts itself when raised."""

    def __init__(self, message: str) -> None:
        super().__init__(message)
        COUNTS[type(self).__name__] += 1


class InvalidArgument(StoreError):
    """The caller's argument can't be used (an empty key, unknown ids, a bad flag)."""


class StoreClosed(StoreError):
    """The store isn't open."""


class IOFailure(StoreError):
    """Files could not be read or written."""


class CorruptionDetected(StoreError):
    """Stored bytes don't match their checksum or format."""


class NotImplemented(StoreError):  # noqa: A001 - the class name is part of the error surface
    """An option that this store doesn't have."""


class Backpressure(StoreError):
    """Too much is waiting to be flushed or compacted; try again later."""


class Cancelled(Exception):
    """A compaction was given up on request; nothing has failed."""


CLASSES = [c.__name__ for c in (InvalidArgument, StoreClosed, IOFailure, CorruptionDetected, NotImplemented, Backpressure)]
