"""All queries of the engine and their DuckDB counterparts, gathered from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that define QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("corpuscle.plans.documents", "corpuscle.plans.packages", "corpuscle.plans.teaching", "corpuscle.plans.rubric", "corpuscle.plans.planning", "corpuscle.plans.runs", "corpuscle.plans.operations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(_name)
    for _into, _more in ((QUERIES, _module.QUERIES), (ORACLES, _module.ORACLES)):
        if clash := _into.keys() & _more.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        _into.update(_more)
