"""All queries of the library itself."""

from furrow.plans import detection, field, gaps, records, reports, shapes, spatial, statistics, streams, telemetry, text  # noqa: F401  they register their queries
from furrow.plans.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
