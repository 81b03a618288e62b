"""Rules that change while a stream runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Generic, TypeVar

Rules = TypeVar("Rules")

FLOOR_SECONDS = 15
DEFAULT_SECONDS = 60


class RuleSource(Generic[Rules]):
    """Loads rules again when they are old; a failed load keeps the last good set.

    Rules are swapped as a whole between batches. A refresh of -1 loads once.
    """

    def __init__(self, load: Callable[[], Rules], refresh_seconds: int = DEFAULT_SECONDS, clock=time.monotonic):
        self._load = load
        self._every = refresh_seconds if refresh_seconds < 0 else max(refresh_seconds or DEFAULT_SECONDS, FLOOR_SECONDS)
        self._clock = clock
        self._loaded_at: float | None = None
        self._rules: Rules | None = None
        self.failures = 0

    def current(self) -> Rules:
        now = self._clock()
        due = self._loaded_at is None or (self._every >= 0 and now - self._loaded_at >= self._every)
        if due:
            try:
                self._rules = self._load()
                self._loaded_at = now
            except Exception:
                self.failures += 1
                if self._rules is None:
                    raise
                self._loaded_at = now
        return self._rules
