"""The state of a cache's entries in a stream of accesses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.windows import expires_at


class Entries(StatefulProcessor):
    """Follows each key's accesses in order of time as far as the watermark has come, and closes entries whose end it has passed."""

    def __init__(self, ttl: float, policy: str):
        self.ttl, self.policy = ttl, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "created double, last double, n long")
        self.waiting = handle.getListState("waiting", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for t in batch["ts"]:
                self.waiting.appendValue((t.timestamp(),))
        yield self.advanced(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advanced(key, timerValues.getCurrentWatermarkInMs())

    def advanced(self, key, mark: int) -> pd.DataFrame:
        """Takes the waiting accesses up to the watermark, closes what has ended by then, and sets the timer at the next moment at which anything can change."""
        now = max(0, mark) / 1000
        times = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [t for t in times if t <= now], [t for t in times if t > now]
        life = tuple(self.open.get()) if self.open.exists() else None
        out = []

        def ended(at: float) -> bool:
            end = expires_at(*life, self.ttl, self.policy)
            return end is not None and at > end

        def close() -> None:
            out.append((key[0], *life, expires_at(*life, self.ttl, self.policy)))

        for t in ready:
            if life and ended(t):
                close()
                life = None
            life = (life[0], t, life[2] + 1) if life else (t, t, 1)
        if life and ended(now):
            close()
            life = None
        if life:
            self.open.update(life)
        elif self.open.exists():
            self.open.clear()
        if rest:
            self.waiting.put([(t,) for t in rest])
        elif self.waiting.exists():
            self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        ends = [rest[0]] if rest else []
        if life and (end := expires_at(*life, self.ttl, self.policy)) is not None:
            ends.append(end)
        if ends:
            self.handle.registerTimer(int(min(ends) * 1000) + 1)
        return pd.DataFrame(out, columns=["key", "created", "last", "n", "expires"])

    def close(self) -> None:
        pass
