"""The latest refresh, kept for a while and shared by those who ask at the same time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from .. import config
from .pipeline import Refresh


class LatestRefresh:
    """get() gives the refresh that make() built last, persisted, until it is older than the time to live or force is set.

    One refresh runs at a time: whoever asks meanwhile waits and gets its result. A refresh
    that fails leaves the last one in place and raises for those who waited for it only."""

    def __init__(self, make: Callable[[], Refresh], minutes: float = config.RESULT_TTL_MINUTES, clock: Callable[[], float] = time.monotonic):
        self._make, self._seconds, self._clock = make, minutes * 60, clock
        self._lock, self._made_at, self._number = threading.Lock(), 0.0, 0
        self._latest: Refresh | None = None

    def get(self, force: bool = False) -> Refresh:
        asked = self._number
        with self._lock:
            fresh = self._latest is not None and self._clock() - self._made_at < self._seconds
            if fresh and not force or self._number > asked:
                return self._latest
            made = self._make()
            for df in (made.events, made.snapshot):
                df.persist()
            if self._latest is not None:
                for df in (self._latest.events, self._latest.snapshot):
                    df.unpersist()
            self._latest, self._made_at, self._number = made, self._clock(), self._number + 1
            return made

    def views(self, prefix: str = "latest_") -> list[str]:
        """Temporary views over the parts of the latest refresh."""
        run = self.get()
        parts = {"articles": run.articles, "events": run.events, "snapshot": run.snapshot, "history": run.history}
        for name, df in parts.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in parts]
