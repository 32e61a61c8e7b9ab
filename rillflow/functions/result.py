"""Error capture on columns: struct<is_success boolean, value T, error struct<type, message>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<type: string, message: string>"


class Result:
    """A result struct as a Column with the methods of a result."""

    def __init__(self, c: Column):
        self.c = c

    @staticmethod
    def success(value: Column) -> Result:
        return Result(F.struct(F.lit(True).alias("is_success"), value.alias("value"), F.lit(None).cast(ERROR).alias("error")))

    @staticmethod
    def failure(message, kind: str, type_: str = "Exception") -> Result:
        """``kind``: the SQL type of the value that is missing."""
        message = message if isinstance(message, Column) else F.lit(message)
        error = F.struct(F.lit(type_).alias("type"), message.cast("string").alias("message")).cast(ERROR)
        return Result(F.struct(F.lit(False).alias("is_success"), F.lit(None).cast(kind).alias("value"), error.alias("error")))

    @staticmethod
    def attempt(tried: Column, of: Column, kind: str, message="not convertible", type_: str = "ValueError") -> Result:
        """From an expression that is null on error (try_cast, try_divide, ...) of a value; a null value succeeds."""
        return Result(F.when(tried.isNull() & of.isNotNull(), Result.failure(message, kind, type_).c).otherwise(Result.success(tried.cast(kind)).c))

    @staticmethod
    def of(f: Callable, of: Column, kind: str) -> Result:
        """What a Python function returns for each value, or the error that it raises."""

        def guarded(x):
            try:
                return True, f(x), None
            except Exception as e:
                return False, None, (type(e).__name__, str(e))

        return Result(F.udf(guarded, f"struct<is_success: boolean, value: {kind}, error: {ERROR}>")(of))

    def is_success(self) -> Column:
        return self.c["is_success"]

    def is_failure(self) -> Column:
        return ~self.c["is_success"]

    def error(self) -> Column:
        return self.c["error"]

    def map(self, f: Callable[[Column], Column], kind: str) -> Result:
        """``f`` is a try_ expression: where it gives null for a value, the result fails."""
        done = Result.attempt(f(self.c["value"]), self.c["value"], kind, "map failed").c
        return Result(F.when(self.is_success(), done).otherwise(self._failed(kind)))

    def flat_map(self, f: Callable[[Column], Result], kind: str) -> Result:
        return Result(F.when(self.is_success(), f(self.c["value"]).c).otherwise(self._failed(kind)))

    def _failed(self, kind: str) -> Column:
        return F.struct(F.lit(False).alias("is_success"), F.lit(None).cast(kind).alias("value"), self.c["error"].alias("error"))

    def map_error(self, f: Callable[[Column], Column]) -> Result:
        """``f`` makes the new message from the old."""
        error = F.struct(self.c["error"]["type"].alias("type"), f(self.c["error"]["message"]).alias("message"))
        return Result(self.c.withField("error", F.when(self.is_failure(), error)))

    def on_success(self, name: str = "successes") -> Column:
        """A counter for DataFrame.observe."""
        return F.count(F.when(self.is_success(), 1)).alias(name)

    def on_failure(self, name: str = "failures") -> Column:
        return F.count(F.when(self.is_failure(), 1)).alias(name)

    def get_or_else(self, default) -> Column:
        """A successful null stays null."""
        return F.when(self.is_success(), self.c["value"]).otherwise(default)

    def get_or_throw(self) -> Column:
        return F.when(self.is_success(), self.c["value"]).otherwise(F.raise_error(self.c["error"]["message"]))

    def __repr__(self) -> str:
        return f"Result({self.c})"
