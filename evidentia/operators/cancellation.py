"""Cancelling work that runs: a flag between steps, and Spark's own for what a step has started."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

T = TypeVar("T")


class Cancelled(RuntimeError):
    """Work that was cancelled before it gave a result."""


class Cancellation:
    """A flag that steps ask, and the tag of the jobs that they start meanwhile."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self._flag = spark, f"evidentia-{uuid.uuid4().hex}", threading.Event()

    def cancel(self) -> None:
        """Set the flag and stop the jobs that run under the tag; others go on."""
        self._flag.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def cancelled(self) -> bool:
        return self._flag.is_set()

    def step(self, work: Callable[[], T]) -> T:
        """Run a step unless cancelled; a step that is stopped in its middle is cancelled, not failed."""
        if self.cancelled():
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return work()
        except (Py4JJavaError, PySparkException) as e:
            if self.cancelled():
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
