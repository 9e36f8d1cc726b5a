"""Registration of queries with their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.views import Views, with_views
from editwake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of the views under its own name."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Views(configure(spark), sf_dir))

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = with_views(sql, *views)
        return build

    return register
