"""Driver-side manners of fetching raw files: a pace between requests, and retries that wait longer each time."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable


class Pace:
    """Lets callers through at most ``per_second`` times a second, one after the other."""

    def __init__(self, per_second: float = 8.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = 1.0 / per_second, clock, sleep
        self.lock, self.free_at = threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            if self.free_at > now:
                self.sleep(self.free_at - now)
            self.free_at = max(now, self.free_at) + self.gap


def retrying(call: Callable, on: tuple[type[BaseException], ...] = (Exception,), attempts: int = 4, first: float = 1.0, most: float = 20.0, jitter: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried up to ``attempts`` times on the given errors; waits double up to ``most``, plus a random part, and the last error is raised."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except on:
                if n + 1 == attempts:
                    raise
                sleep(min(most, first * 2**n) + random.uniform(0, jitter))

    return run
