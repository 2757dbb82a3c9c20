"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from spanframe.plans import building_queries, corpus_queries, decode_queries, encoding_queries, ensemble_queries, pool_queries, record_queries, span_queries, target_queries, text_queries  # noqa: F401
from spanframe.plans.base import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
