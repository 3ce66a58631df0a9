"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import catalogue_linkage, catalogue_privacy


def queries() -> dict:
    return {**catalogue_privacy.QUERIES, **catalogue_linkage.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalogue_privacy.SQL, **catalogue_linkage.SQL}
