"""Registered queries: a Spark job on the given tables, and the SQL that checks it.

``rounded`` names the double columns compared at six decimals. Both sides round by the same arithmetic,
because the engines' own ``round`` differ where a value prints as a tie but is stored just beside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.sources import mapping as M

Run = Callable[[SparkSession, str], DataFrame]
SCALE = 1000000


@dataclass(frozen=True)
class Query:
    run: Run
    oracle: str | None


REGISTRY: dict[str, Query] = {}

# Shared subqueries of the checking SQL; a query carries only those it mentions.
CTES: dict[str, str] = {
    "raw_sessions": f"SELECT {M.columns_sql(M.EVENT_SESSIONS)} FROM events",
    "sessions": "SELECT *, CAST(hour(charging_start_time) AS INT) AS start_hour, "
                "charging_duration_hours * 60 AS charging_duration_minutes FROM raw_sessions "
                "WHERE energy_consumed_kwh IS NOT NULL AND charging_duration_hours IS NOT NULL",
    "long_sessions": f"SELECT {M.columns_sql(M.ORDER_SESSIONS)} FROM orders",
    "requests": f"SELECT {M.columns_sql(M.REQUESTS)} FROM customer",
    "labels": f"SELECT charging_station_id, {M.LABEL_RULE} AS cluster FROM "
              f"(SELECT DISTINCT charging_station_id FROM sessions) WHERE {M.LABEL_FILTER}",
    "daily": "SELECT charging_station_id, CAST(charging_start_time AS DATE) AS session_date, "
             "count(user_id) AS total_sessions, sum(energy_consumed_kwh) AS total_energy_kwh, "
             "avg(charging_duration_minutes) AS avg_duration_minutes FROM sessions GROUP BY 1, 2",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    available = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in available.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = [f"{n} AS ({available[n]})" for n in needed]
    return ",\n".join(parts)


def oracle_text(body: str, rounded: Sequence[str], extra: dict[str, str] | None) -> str:
    ctes = with_ctes(body, extra)
    replaced = ", ".join(f"floor({c} * {SCALE!r} + 5e-1) / {SCALE!r} AS {c}" for c in rounded)
    tail = f"SELECT * REPLACE ({replaced}) FROM result" if rounded else "SELECT * FROM result"
    return f"WITH {ctes + ',' if ctes else ''}\nresult AS ({body})\n{tail}"


def query(name: str, oracle: str | None = None, rounded: Sequence[str] = (), extra: dict[str, str] | None = None):
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def rounded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = run(spark, sf_dir)
            return df.withColumns({c: F.floor(F.col(c) * SCALE + 0.5) / SCALE for c in rounded}) if rounded else df

        REGISTRY[name] = Query(rounded_run, oracle_text(oracle, rounded, extra) if oracle else None)
        return run

    return register


_MEMO: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], object]):
    """Build a stored artifact (written table, fitted model) once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]
