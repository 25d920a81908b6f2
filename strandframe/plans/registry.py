"""All queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; ``sql`` is what DuckDB runs for the same rows (None: SQL can't express it)."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import bytes as _bytes  # noqa: E402, F401
from . import contexts as _contexts  # noqa: E402, F401
from . import objects as _objects  # noqa: E402, F401
from . import portfolio as _portfolio  # noqa: E402, F401
from . import relations as _relations  # noqa: E402, F401
from . import series as _series  # noqa: E402, F401
from . import service as _service  # noqa: E402, F401
from . import streams as _streams  # noqa: E402, F401
