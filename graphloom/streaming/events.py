"""What tells pages that something has changed, and values that are good for a while."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any


class Bus:
    """Topics to whose listeners a change is told; changes that a listener hasn't read yet are one."""

    def __init__(self) -> None:
        self._lock, self._topics = threading.Lock(), {}

    def publish(self, topic: str) -> None:
        with self._lock:
            for q in self._topics.get(topic, ()):
                try:
                    q.put_nowait(topic)
                except queue.Full:
                    pass  # one is waiting already

    @contextmanager
    def listen(self, topic: str) -> Iterator[queue.Queue]:
        q: queue.Queue = queue.Queue(1)
        with self._lock:
            self._topics.setdefault(topic, []).append(q)
        try:
            yield q
        finally:
            with self._lock:
                self._topics[topic].remove(q)
                if not self._topics[topic]:
                    del self._topics[topic]


class Fresh:
    """A value for each key that is loaded again once it is older than `ttl` seconds; a failed load keeps the old one."""

    def __init__(self, load: Callable[[Any], Any], ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self._load, self._ttl, self._clock = load, ttl, clock
        self._lock, self._held = threading.Lock(), {}

    def get(self, key: Any) -> Any:
        with self._lock:
            at, value = self._held.get(key, (None, None))
            if at is not None and self._clock() - at < self._ttl:
                return value
            try:
                value = self._load(key)
            except Exception:
                if at is None:
                    raise
            self._held[key] = self._clock(), value
            return value

    def drop(self, key: Any) -> None:
        with self._lock:
            self._held.pop(key, None)
