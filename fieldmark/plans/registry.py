"""Procedures under names, so that others can add their own beside the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldmark.plans.analyze import Result, Spec, analyze


@dataclass(frozen=True)
class Procedure:
    """A named step from a table and a form to a result, with the fields of the form it needs."""

    name: str
    run: Callable[[DataFrame, Spec], Result]
    needs: tuple[str, ...] = ()
    about: str = ""


_known: dict[str, Procedure] = {}


def procedure(name: str, needs: tuple[str, ...] = (), about: str = "") -> Callable:
    """Register a function under a name; a name that is taken raises."""

    def keep(run: Callable[[DataFrame, Spec], Result]) -> Callable:
        if name in _known:
            raise ValueError(f"procedure {name} exists")
        _known[name] = Procedure(name, run, needs, about)
        return run

    return keep


def procedures() -> list[Procedure]:
    return sorted(_known.values(), key=lambda p: p.name)


def run(name: str, df: DataFrame, spec: Spec) -> Result:
    """One procedure by name; fields that it needs and the form leaves empty raise."""
    if name not in _known:
        raise KeyError(f"no procedure {name}; known: {', '.join(sorted(_known))}")
    lacking = [f for f in _known[name].needs if not getattr(spec, f)]
    if lacking:
        raise ValueError(f"{name} needs {', '.join(lacking)}")
    return _known[name].run(df, spec)


procedure("analyze", about="the procedure that the form asks for")(analyze)
