"""pipe, curry and retry."""

from __future__ import annotations

import asyncio
import functools
import inspect
import random
from collections.abc import Callable
from typing import Any


def pipe(value: Any, *functions: Callable) -> Any:
    """h(g(f(value))); with a DataFrame as value, a chain of transforms."""
    return functools.reduce(lambda v, f: f(v), functions, value)


def curry(f: Callable) -> Callable:
    """``f`` taking its required arguments a few at a time."""
    needed = sum(p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in inspect.signature(f).parameters.values())

    def collect(*got):
        return f(*got) if len(got) >= needed else lambda *more: collect(*got, *more)

    return functools.wraps(f)(collect)


def retry(attempts: int = 3, backoff: float = 1.5, jitter: bool = True, exceptions: tuple = (Exception,), first: float = 1.0) -> Callable:
    """Decorates a coroutine function: waits ``first`` seconds, then ``backoff`` times as long each time."""
    if attempts < 1:
        raise ValueError("attempts must be at least 1")

    def decorate(f):
        @functools.wraps(f)
        async def run(*args, **kwargs):
            wait = first
            for left in range(attempts - 1, -1, -1):
                try:
                    return await f(*args, **kwargs)
                except exceptions:
                    if not left:
                        raise
                    await asyncio.sleep(wait * (1 + random.random() / 10 * jitter))
                    wait *= backoff

        return run

    return decorate
