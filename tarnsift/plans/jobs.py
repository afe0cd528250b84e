"""Jobs that make score tables from score tables, in the order of what they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Job:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = field(default=())


def run_all(spark: SparkSession, jobs: list[Job], given: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Results by name.  Everything stays lazy; a cycle raises."""
    by_name, out = {j.name: j for j in jobs}, dict(given or {})
    order = TopologicalSorter({j.name: set(j.needs) for j in jobs})
    for name in order.static_order():
        if name not in out:
            job = by_name[name]
            out[name] = job.run(spark, {n: out[n] for n in job.needs})
    return out
