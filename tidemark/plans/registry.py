"""All queries of the reference's operator families, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("tokens", "spans", "matches", "audio", "folding", "nested", "queue", "media", "projects", "channels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"tidemark.plans.{name}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"tidemark.plans.{name}").ORACLES
    return out
