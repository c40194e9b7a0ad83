"""Stopping a stream between micro-batches: after a number of events, or when asked to."""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery


class Drained(RuntimeError):
    """Raised in place of a micro-batch that begins after the stop was asked for; its offsets stay uncommitted."""


class Drain:
    """Lets the running micro-batch finish, and no other begin, once `max_events` were handled or `request` was called."""

    def __init__(self, max_events: int | None = None):
        self.max_events, self.events, self.last_batch = max_events, 0, -1
        self._asked = self._running = False
        self._changed = threading.Condition()

    def request(self, *_) -> None:
        """Ask for the stop. Also a handler of signals: it takes no lock."""
        self._asked = True

    def around(self, handle: Callable) -> Callable:
        """`handle(batch, batch_id)` returns the number of its events."""
        def guarded(batch, batch_id: int) -> None:
            with self._changed:
                if self._asked:
                    raise Drained(f"stopped before batch {batch_id}")
                self._running = True
            try:
                self.events += handle(batch, batch_id) or 0
                self.last_batch = batch_id
                if self.max_events and self.events >= self.max_events:
                    self._asked = True
            finally:
                with self._changed:
                    self._running = False
                    self._changed.notify_all()
        return guarded

    def wait(self, query: StreamingQuery, poll: float = 0.05, commit_wait: float = 30.0) -> None:
        """Wait until the query ends by itself, fails, or has been stopped; a stop leaves no batch half done."""
        try:
            while query.isActive and not self._asked:
                query.awaitTermination(poll)
            if query.isActive:
                with self._changed:
                    self._changed.wait_for(lambda: not self._running)
                # The offsets of the last batch are committed by Spark after it: its progress tells.
                end = time.monotonic() + commit_wait
                while query.isActive and time.monotonic() < end and self.last_batch >= 0:
                    progress = query.lastProgress
                    if progress is not None and progress["batchId"] >= self.last_batch:
                        break
                    time.sleep(poll)
                query.stop()
            query.awaitTermination()
        except StreamingQueryException as error:
            if Drained.__name__ not in str(error):
                raise

    def on_signals(self, *numbers: int) -> Callable[[], None]:
        """Stop on these signals (main thread only); returns a function that restores the handlers of before."""
        before = {number: signal.signal(number, self.request) for number in numbers}
        return lambda: [signal.signal(number, handler) for number, handler in before.items()]
