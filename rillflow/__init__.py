"""A PySpark-native engine with a fluent, functional data-processing API."""

from rillflow.dataset import Dataset
from rillflow.exceptions import DependencyMissingError, ParallelExecutionError, StreamEmptyError, StreamError
from rillflow.functions.functional import curry, pipe, retry
from rillflow.functions.option import Option
from rillflow.functions.result import Result
from rillflow.operators import collectors as Collectors

__all__ = ["Collectors", "Dataset", "DependencyMissingError", "Option", "ParallelExecutionError", "Result", "StreamEmptyError", "StreamError", "curry", "pipe", "retry"]
