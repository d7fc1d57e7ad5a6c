"""Jobs with states: each run is a row of a log, and a job may run others with its tags."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "id string, parent string, algorithm string, status string, message string, tags array<string>, started double, ended double"


@dataclass
class Execution:
    """One run: PENDING, then STARTED, then FINISHED or FAILED."""

    algorithm: str
    tags: tuple[str, ...] = ()
    parent: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "PENDING"
    message: str | None = None
    started: float | None = None
    ended: float | None = None


class Runner:
    """Runs algorithms by name (a function of a runner, an execution and keyword arguments) and keeps their executions."""

    def __init__(self, spark: SparkSession, algorithms: dict[str, Callable]):
        self.spark, self.algorithms, self.executions = spark, dict(algorithms), []

    def run(self, algorithm: str, tags: tuple[str, ...] = (), parent: Execution | None = None, **parameters: Any) -> tuple[Execution, Any]:
        """(execution, result); a fault ends the execution as FAILED with its message and result None, and leaves the runner usable."""
        execution = Execution(algorithm, tuple(dict.fromkeys([*(parent.tags if parent else ()), *tags])), parent.id if parent else None)
        self.executions.append(execution)
        execution.status, execution.started = "STARTED", time.time()
        result = None
        try:
            if algorithm not in self.algorithms:
                raise ValueError(f"algorithm must be one of {sorted(self.algorithms)}")
            result = self.algorithms[algorithm](self, execution, **parameters)
            execution.status = "FINISHED"
        except Exception as e:  # noqa: BLE001  whatever went wrong is the execution's message
            execution.status, execution.message = "FAILED", f"{type(e).__name__}: {e}"
        execution.ended = time.time()
        return execution, result

    def log(self) -> DataFrame:
        rows = [(e.id, e.parent, e.algorithm, e.status, e.message, list(e.tags), e.started, e.ended) for e in self.executions]
        return self.spark.createDataFrame(rows, LOG)


def status_counts(log: DataFrame, by: str = "status") -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def coerced(cls: type, values: dict[str, Any]) -> Any:
    """A dataclass from text values: numbers, truth values and lists (after commas) by the kind of the field's default; unknown fields are an error."""
    known = {f.name: f for f in fields(cls)}
    if unknown := set(values) - set(known):
        raise TypeError(f"unknown fields {sorted(unknown)}")

    def one(name: str, value: Any) -> Any:
        kind = known[name].type if isinstance(known[name].type, str) else known[name].type.__name__
        if not isinstance(value, str) or kind.startswith("str"):
            return tuple(value) if isinstance(value, list) else value
        if kind.startswith("bool"):
            return value.strip().lower() in ("true", "1", "yes")
        if kind.startswith("int"):
            return int(value)
        if kind.startswith("float"):
            return float(value)
        return tuple(x.strip() for x in value.split(",") if x.strip()) if kind.startswith("tuple") else value

    return cls(**{k: one(k, v) for k, v in values.items()})

