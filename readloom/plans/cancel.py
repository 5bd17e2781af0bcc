"""Running a workflow so that it can be cancelled from elsewhere."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The work was cancelled before it was done."""


class Running:
    """Work in a thread of its own whose Spark jobs share a tag; ``cancel`` ends them, ``result`` waits."""

    def __init__(self, spark: SparkSession, work: Callable[[], Any]):
        self._spark, self._tag = spark, f"work-{uuid.uuid4().hex}"
        self._value: Any = None
        self._error: BaseException | None = None
        self._stopped = threading.Event()

        def run() -> None:
            spark.sparkContext.addJobTag(self._tag)
            try:
                self._value = work()
            except BaseException as e:  # handed to the caller of result
                self._error = e
            finally:
                spark.sparkContext.removeJobTag(self._tag)

        from pyspark import InheritableThread

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    def cancel(self) -> None:
        """Ends all jobs of the work, running and to come; harmless when it is done."""
        self._stopped.set()
        while self._thread.is_alive():
            self._spark.sparkContext.cancelJobsWithTag(self._tag)
            self._thread.join(0.2)

    def result(self) -> Any:
        self._thread.join()
        if self._error is not None:
            if self._stopped.is_set():
                raise Cancelled("cancelled") from self._error
            raise self._error
        return self._value
