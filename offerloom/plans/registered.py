"""The catalogue's register."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


CATALOG: dict[str, Registered] = {}


def register(name: str, covers: str, sql: str | None = None):
    def add(run):
        assert name not in CATALOG, name
        CATALOG[name] = Registered(run, sql, covers)
        return run

    return add
