"""Errors of the library."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException, PythonException


class StreamError(PySparkException):
    """Base of the library's errors."""

    def __init__(self, message: str):
        super().__init__(message)


class StreamEmptyError(StreamError):
    """An operation needs at least one element."""


class ParallelExecutionError(StreamError):
    """A task of a Python stage failed."""


class DependencyMissingError(StreamError):
    """An optional package is not installed."""


@contextmanager
def task_errors() -> Iterator[None]:
    """What Python code raises in a task arrives as ParallelExecutionError, a package missing here as DependencyMissingError."""
    try:
        yield
    except PythonException as e:
        raise ParallelExecutionError(str(e)) from e
    except ImportError as e:
        raise DependencyMissingError(str(e)) from e
