"""Event buses over batches of change records: handlers see events by (priority, lsn)."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from strataspan.sources.changes import events


class EventBus:
    """Synchronous: `publish` returns when every handler has seen the batch. A batch goes through the driver in partitions, so a handler
    that needs whole batches should take the DataFrame (`on_batch`)."""

    def __init__(self) -> None:
        self.handlers: list[tuple[set[str] | None, Callable[[Row], None]]] = []
        self.batch_handlers: list[Callable[[DataFrame], None]] = []

    def on(self, handler: Callable[[Row], None], types: set[str] | None = None) -> None:
        self.handlers.append((types, handler))

    def on_batch(self, handler: Callable[[DataFrame], None]) -> None:
        self.batch_handlers.append(handler)

    def publish(self, log: DataFrame) -> None:
        found = events(log).orderBy("priority", "lsn")
        for h in self.batch_handlers:
            h(found)
        if self.handlers:
            for row in found.toLocalIterator():
                for types, h in self.handlers:
                    if types is None or row["type"] in types:
                        h(row)


class AsyncEventBus(EventBus):
    """A worker thread takes batches from a bounded queue; when it is full: block, drop_oldest or drop_latest."""

    def __init__(self, size: int = 16, full: str = "block") -> None:
        super().__init__()
        if full not in ("block", "drop_oldest", "drop_latest"):
            raise ValueError(full)
        self.full, self.dropped, self.failed, self._queue = full, 0, [], queue.Queue(size)
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while True:
            log = self._queue.get()
            try:
                super().publish(log)
            except Exception as e:  # a handler's fault ends neither the worker nor `drain`
                self.failed.append(e)
            finally:
                self._queue.task_done()

    def publish(self, log: DataFrame) -> None:
        if self.full == "block":
            self._queue.put(log)
            return
        while True:
            try:
                self._queue.put_nowait(log)
                return
            except queue.Full:
                self.dropped += 1
                if self.full == "drop_latest":
                    return
                try:
                    self._queue.get_nowait()
                    self._queue.task_done()
                except queue.Empty:
                    pass

    def drain(self) -> None:
        self._queue.join()


def attach(bus: EventBus) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a watched change log."""
    return lambda df, _: bus.publish(df)
