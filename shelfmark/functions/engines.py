"""Analysis engines by capability, each result with where it comes from.

An engine is a function from a pandas Series to a pandas Series. Later registrations for
a capability win; one that nothing serves falls back to the default engine.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Engine:
    model_id: str
    model_version: str
    confidence: float
    run: Callable[[pd.Series], pd.Series]


@dataclass
class Registry:
    default: Engine
    engines: dict[str, list[Engine]] = field(default_factory=dict)

    def register(self, capability: str, engine: Engine) -> None:
        self.engines.setdefault(capability, []).append(engine)

    def engine_for(self, capability: str) -> Engine:
        return (self.engines.get(capability) or [self.default])[-1]

    def analyse(self, capability: str, column: Column, kind: str) -> Column:
        """Struct of value (of type `kind`), model_id, model_version, confidence, exec_ms.

        Rows go to Python in Arrow batches; exec_ms is a row's part of its batch's time.
        """
        e = self.engine_for(capability)

        @F.pandas_udf(f"value {kind}, model_id string, model_version string, confidence double, exec_ms double")
        def udf(values: pd.Series) -> pd.DataFrame:
            began = time.perf_counter()
            out = e.run(values)
            ms = (time.perf_counter() - began) * 1000 / max(len(values), 1)
            return pd.DataFrame({"value": out, "model_id": e.model_id, "model_version": e.model_version, "confidence": e.confidence, "exec_ms": ms})

        return udf(column)
