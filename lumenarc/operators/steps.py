"""A run as steps that can be skipped, resumed and summed up.

A step makes tables from earlier ones. What it reports is observed while its
tables are written, by ``Observation``, so no number costs a second pass. The
record in the output folder names the steps that are complete; a run that
starts again takes up their tables and goes on with the first that is not.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from lumenarc.operators import progress

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """``make`` gives the step's tables from those so far; ``skip`` why the options leave it out, or None; ``observe`` aggregates by table and name."""

    id: int
    name: str
    make: Callable[[SparkSession, Tables], Tables]
    observe: dict[str, dict[str, Column]] = field(default_factory=dict)
    skip: Callable[[dict], str | None] = lambda options: None


@dataclass(frozen=True)
class Outcome:
    id: int
    name: str
    state: str  # done, resumed or skipped
    metrics: dict
    seconds: float = 0.0
    message: str = ""


def run(spark: SparkSession, steps: list[Step], in_root: str, out_root: str, options: dict | None = None) -> tuple[list[Outcome], Tables]:
    """Outcomes of all steps, in order, and the tables that they leave.

    A skipped step makes no tables and is not recorded, so other options may
    run it later. A step that fails ends the run; those before it stay recorded.
    """
    complete = progress.completed(progress.load(out_root))
    tables = progress.restore(spark, out_root, in_root) if complete else {}
    outcomes = []
    for step in steps:
        if why := step.skip(options or {}):
            outcomes.append(Outcome(step.id, step.name, "skipped", {}, message=why))
            continue
        if step.id in complete:
            known = (progress.load(out_root).get("steps") or {}).get(str(step.id), {})
            outcomes.append(Outcome(step.id, step.name, "resumed", known.get("result") or {}))
            continue
        began = time.perf_counter()
        made, seen = step.make(spark, tables), []
        for name, of in step.observe.items():
            watch = Observation(f"{step.name}-{name}")
            made[name] = made[name].observe(watch, *(c.alias(n) for n, c in of.items()))
            seen.append(watch)
        metrics: dict = {}

        def measured(seen=seen, metrics=metrics) -> dict:
            for watch in seen:
                metrics.update(watch.get)
            return metrics

        progress.save(out_root, step.id, time.perf_counter() - began, measured, made, in_root)
        tables = progress.restore(spark, out_root, in_root)
        outcomes.append(Outcome(step.id, step.name, "done", metrics, time.perf_counter() - began))
    return outcomes, tables


def summary(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """step, state, metric, value of each number that the steps observed."""
    rows = [(o.name, o.state, m, int(v)) for o in outcomes for m, v in sorted(o.metrics.items()) if isinstance(v, int)]
    return spark.createDataFrame(rows, "step string, state string, metric string, value long")
