"""When to try again: delays in seconds as policies, and a supervisor that follows them.

Tasks that fail are run again by Spark; these policies are for what runs on the driver: a collector's connection, a
provider's request, a long job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from itertools import chain, repeat
from typing import TypeVar

T = TypeVar("T")
Policy = Callable[[], Iterator[float]]


def patient() -> Iterator[float]:
    """Half a second, doubled up to 64, which then repeats for ever."""
    return chain((0.5 * 2**k for k in range(8)), repeat(64.0))


def doubling(first: float = 1.0, limit: float = 30.0) -> Iterator[float]:
    """Doubled as long as it is no more than limit; then the failure stands."""
    while first <= limit:
        yield first
        first *= 2


def counted(tries: int = 5) -> Iterator[float]:
    """0, 1, 2 … seconds after each of so many tries; then the failure stands."""
    return iter(map(float, range(tries)))


def fixed(seconds: float) -> Policy:
    return lambda: repeat(seconds)


def supervised(action: Callable[[], T], policies: Mapping[type[Exception], Policy], sleep: Callable[[float], None] = time.sleep) -> T:
    """The action's result. An exception waits as the first policy of its kind says and tries again; one that no policy
    names, or whose policy has ended, is raised."""
    going: dict[type[Exception], Iterator[float]] = {}
    while True:
        try:
            return action()
        except Exception as e:
            kind = next((k for k in policies if isinstance(e, k)), None)
            wait = None if kind is None else next(going.setdefault(kind, policies[kind]()), None)
            if wait is None:
                raise
            sleep(wait)
