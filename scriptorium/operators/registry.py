"""Plug-ins by name: functions from DataFrame to DataFrame that are put in from outside."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame

RESERVED = {"default", "none"}
_KNOWN: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, step: Callable[..., DataFrame]) -> None:
    if name in RESERVED or name in _KNOWN:
        raise ValueError(f"{name} is taken")
    _KNOWN[name] = step


def get(name: str, group: str = "scriptorium.steps") -> Callable[..., DataFrame]:
    """The step registered by ``name``, else that of exactly one installed entry point."""
    if name in _KNOWN:
        return _KNOWN[name]
    found = list(entry_points(group=group, name=name))
    if len(found) != 1:
        raise KeyError(f"{len(found)} steps are named {name}")
    return found[0].load()


def classify_once(rows: DataFrame, key: str, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Calls ``classify`` on one row per distinct key and joins its answers to all rows."""
    answers = classify(rows.dropDuplicates([key]))
    return rows.join(answers, key, "left")
