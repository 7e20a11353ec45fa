"""The context of a run: procedures whose failures stay their own, and a log that the jobs fill.

Figures of the log are observed while a result is written, so they cost no job of their own.
"""

from __future__ import annotations

import importlib
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.columns import col
from fieldmark.plans import registry
from fieldmark.plans.analyze import Result, Spec

LOG = "step string, state string, rows long, nulls map<string, bigint>, seconds double, message string"


@dataclass
class Run:
    """One run over a session: its log, its results and what failed."""

    spark: SparkSession
    entries: list[tuple] = field(default_factory=list)
    results: dict[str, Result] = field(default_factory=dict)

    def _note(self, step: str, began: float, state: str = "done", rows: int | None = None, nulls: dict | None = None, message: str = "") -> None:
        self.entries.append((step, state, rows, nulls, round(time.time() - began, 3), message))

    def save(self, df: DataFrame, step: str, path: str) -> DataFrame:
        """``df`` written as Parquet and read again; its rows and the nulls of each column are
        counted by the job that writes it. A failure is logged and raised."""
        began, seen = time.time(), Observation(step)
        names = [f"n{k}" for k in range(len(df.columns))]
        try:
            df.observe(seen, F.count("*").alias("rows"), *[F.count_if(col(c).isNull()).alias(n) for c, n in zip(df.columns, names, strict=True)]).write.parquet(path)
        except Exception as e:
            self._note(step, began, "failed", message=str(e).splitlines()[0][:500])
            raise
        got = seen.get
        self._note(step, began, rows=got["rows"], nulls={c: got[n] for c, n in zip(df.columns, names, strict=True) if got[n]})
        return self.spark.read.schema(df.schema).parquet(path)

    def plug_in(self, modules: list[str]) -> None:
        """Import modules that register procedures; one that can't be imported is logged and left out."""
        for name in modules:
            began = time.time()
            try:
                importlib.import_module(name)
            except Exception as e:  # whatever a plug-in does wrong is its own
                self._note(name, began, "broken", message=f"{type(e).__name__}: {e}"[:500])

    def run_all(self, df: DataFrame, spec: Spec, names: list[str] | None = None) -> dict[str, Result]:
        """The results of all procedures (or those named) that the form has the fields for; one that
        fails is logged and the others go on."""
        for p in registry.procedures():
            if names is not None and p.name not in names:
                continue
            began = time.time()
            lacking = [f for f in p.needs if not getattr(spec, f)]
            if lacking:
                self._note(p.name, began, "skipped", message=f"needs {', '.join(lacking)}")
                continue
            try:
                self.results[p.name] = registry.run(p.name, df, spec)
                self._note(p.name, began)
            except Exception as e:
                self._note(p.name, began, "failed", message=f"{type(e).__name__}: {e}".splitlines()[0][:500])
        return self.results

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self.entries, LOG)
