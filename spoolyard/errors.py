"""Errors of queue operations, raised on the driver or carried as codes in reject rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

DATA_TYPE_MISMATCH = "DATA_TYPE_MISMATCH"
QUEUE_NOT_FOUND = "QUEUE_NOT_FOUND"
QUEUE_UNPREPARED = "QUEUE_UNPREPARED"
NOTHING_TO_FIRE = "NOTHING_TO_FIRE"
INVALID_SHARDS = "INVALID_SHARDS"
ACTION_DENIED_PARALLEL_ATTEMPT = "ACTION_DENIED_PARALLEL_ATTEMPT"
RETRIES_EXHAUSTED = "RETRIES_EXHAUSTED"
CONNECTION_ERROR = "CONNECTION_ERROR"
NOT_IMPLEMENTED = "NOT_IMPLEMENTED"
INTERNAL_ERROR = "INTERNAL_ERROR"


class QueueError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
        self.message = message


#: Names of exception classes, Java's and Python's, that say that the store could not be reached, read or written (fixed values).
STORE_FAILURES = ("IOException", "ConnectException", "SocketException", "AccessDeniedException", "FileNotFoundException", "Py4JNetworkError", "OSError")


def _causes(error: BaseException) -> list[str]:
    """Class names of an error and of what caused it, in Python and, where it comes from there, in Java."""
    names, seen = [], error
    while seen is not None:
        names += [k.__name__ for k in type(seen).__mro__]
        java = getattr(seen, "java_exception", None)
        while java is not None and len(names) < 200:
            kind = java.getClass()
            while kind is not None:
                names.append(kind.getSimpleName())
                kind = kind.getSuperclass()
            java = java.getCause()
        seen = seen.__cause__
    return names


def wrap(error: Exception) -> QueueError:
    """A QueueError, itself or as the cause, passes through; failures of the store become CONNECTION_ERROR, all else INTERNAL_ERROR."""
    for e in (error, error.__cause__):
        if isinstance(e, QueueError):
            return e
    failed = not set(STORE_FAILURES).isdisjoint(_causes(error))
    out = QueueError(CONNECTION_ERROR, "the store failed") if failed else QueueError(INTERNAL_ERROR, "Error occurred")
    out.__cause__ = error
    return out


def guarded(operation: Callable) -> Callable:
    """The operation with its errors mapped by wrap()."""

    @functools.wraps(operation)
    def run(*args, **named):
        try:
            return operation(*args, **named)
        except QueueError:
            raise
        except Exception as e:
            raise wrap(e) from e

    return run
