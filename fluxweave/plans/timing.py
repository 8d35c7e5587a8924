"""Seconds and shares of the phases of a remap, appended to a file a run at a time."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Phases:
    """``with phases("search"): ...`` adds up seconds by name; work must be carried out inside (write or count it)."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def shares(self) -> dict[str, float]:
        """Percent of the total by phase."""
        total = sum(self.seconds.values())
        return {k: 100 * v / total if total else 0.0 for k, v in self.seconds.items()}

    def frame(self, spark: SparkSession) -> DataFrame:
        """(phase, seconds, percent) in the order of their first use."""
        share = self.shares()
        return spark.createDataFrame([(k, v, share[k]) for k, v in self.seconds.items()], "phase string, seconds double, percent double")

    def append(self, path: str, **about) -> None:
        """One JSON line: what the run was, and the seconds of its phases."""
        with open(path, "a") as f:
            f.write(json.dumps({**about, "seconds": {k: round(v, 6) for k, v in self.seconds.items()}}) + "\n")
