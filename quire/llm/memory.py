"""What a Python worker remembers from one batch to the next, within a bound."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager


@contextmanager
def uncollected() -> Iterator[None]:
    """Leave out the search for reference cycles, which walks through all that is remembered.

    For code that makes none: what it drops is freed by its reference count.
    """
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Memory:
    """A dictionary of at most twice ``limit`` entries that keeps what was used lately.

    Entries live in two generations. A full young one becomes the old one, whose
    entries come back when they are asked for and are forgotten otherwise.
    """

    def __init__(self, limit: int = 300_000) -> None:
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """The keys it doesn't know; those of the old generation become young."""
        new = []
        for key in keys - self.young.keys():
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self.young[key] = value
        return new

    def make_room(self) -> None:
        """Call between batches: what is young then stays known for the next one."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
