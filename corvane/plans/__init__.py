"""The registered queries: by name, the Spark callable and the same in SQL (None where SQL can't say it)."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for module in pkgutil.iter_modules(__path__):
        found = importlib.import_module(f"{__name__}.{module.name}").QUERIES
        if again := out.keys() & found:
            raise ValueError(f"registered twice: {sorted(again)}")
        out |= found
    return out
