"""Which results are out of date, by what each declares to need.

A result is stale where its oldest file is older than the newest file of something it needs, and
so is everything behind a stale or missing one. Only file names and times are read.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Artifact:
    """A result: the paths that make it up, and what it needs, other results by name or paths."""

    name: str
    outputs: list[str]
    needs: list[str] = field(default_factory=list)


def times(spark: SparkSession, path: str) -> tuple[datetime.datetime, datetime.datetime] | None:
    """Times of the oldest and the newest file below a path, None if there are none. A store that
    can't be read raises; only a missing path is missing."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    old, new = files.agg(F.min("modificationTime"), F.max("modificationTime")).first()
    return (old, new) if old else None


STATES = "name string, done boolean, stale boolean, because array<string>"


def states(spark: SparkSession, artifacts: list[Artifact]) -> DataFrame:
    """``name, done, stale, because`` of every result, those that are needed first.

    ``done``: all its paths hold files. ``because`` names the needs that are newer, stale or
    missing. A result that isn't done is not stale itself, but what needs it is. Needs that
    go in a circle raise.
    """
    by_name = {a.name: a for a in artifacts}
    if len(by_name) < len(artifacts):
        raise ValueError("two results have one name")
    try:
        order = [*TopologicalSorter({a.name: [n for n in a.needs if n in by_name] for a in artifacts}).static_order()]
    except CycleError as e:
        raise ValueError(f"needs go in a circle: {' - '.join(e.args[1])}") from None
    paths = {p for a in artifacts for p in a.outputs} | {n for a in artifacts for n in a.needs if n not in by_name}
    seen = {p: times(spark, p) for p in sorted(paths)}
    rows, done, stale = [], {}, {}
    for name in order:
        a = by_name[name]
        done[name] = bool(a.outputs) and all(seen[p] for p in a.outputs)
        oldest = min((seen[p][0] for p in a.outputs), default=None) if done[name] else None
        because = []
        for need in a.needs:
            parts = by_name[need].outputs if need in by_name else [need]
            behind = need in by_name and (stale[need] or not done[need])
            newer = oldest is not None and any(seen[p] and seen[p][1] > oldest for p in parts)
            if behind or newer:
                because.append(need)
        stale[name] = done[name] and bool(because)
        rows.append((name, done[name], stale[name], because if done[name] else []))
    return spark.createDataFrame(rows, STATES)
