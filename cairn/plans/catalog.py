"""All queries of the library, without the optional training-data operators."""

from __future__ import annotations

from . import curve_queries, detail_queries, feature_queries, record_queries, select_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query

flagship = curve_queries.flagship


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
