"""Registry of runnable queries: each couples a Spark job with the same result written as SQL.

An output spec such as ``"ticker:s session_date:d close:f"`` fixes the type and rounding of every column on both sides:
s text, l 64-bit integer, b boolean, d date as text, t timestamp as text, fN double rounded to N places (6 when omitted).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.views import CTES, Views
from tidemark.session import widen

JOBS: dict = {}
_BODIES: dict[str, tuple[str, str]] = {}


def _spec(spec: str):
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def nudge(places: int) -> float:
    """Added before rounding on both sides, so that an exact half never depends on an engine's tie rule."""
    return 3.7e-4 * 10.0 ** -places


def project(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _spec(spec):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "l":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "t":
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        else:
            places = int(kind[1:] or 6)
            c = F.round(c.cast("double") + F.lit(nudge(places)), places) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def _sql_project(spec: str) -> str:
    out = []
    for name, kind in _spec(spec):
        if kind == "s":
            e = f"CAST({name} AS VARCHAR)"
        elif kind == "l":
            e = f"CAST({name} AS BIGINT)"
        elif kind == "b":
            e = f"CAST({name} AS BOOLEAN)"
        elif kind == "d":
            e = f"CAST(CAST({name} AS DATE) AS VARCHAR)"
        elif kind == "t":
            e = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
        else:
            places = int(kind[1:] or 6)
            e = f"round(CAST({name} AS DOUBLE) + {nudge(places):.6e}, {places}) + 0e0"
        out.append(f"{e} AS {name}")
    return ", ".join(out)


_SOURCE = re.compile(r"(?:\bfrom|\bjoin|,)\s+([a-z_0-9]+)", re.IGNORECASE)


def _with_ctes(body: str, spec: str) -> str:
    """The body behind the shared views it reads, each listed after the views it needs itself."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str):
        for word in dict.fromkeys(_SOURCE.findall(text)):
            if word in CTES and word not in seen:
                seen.add(word)
                visit(CTES[word])
                needed.append(word)

    visit(body)
    parts = [f"{n} AS ({CTES[n]})" for n in needed] + [f"answer AS ({body})"]
    return "WITH " + ",\n".join(parts) + f"\nSELECT {_sql_project(spec)} FROM answer"


def query(name: str, spec: str, sql: str | None = None):
    """Register a job under ``name``; ``sql`` may use any shared view by name."""
    def register(fn):
        if name in JOBS:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            widen(spark, sf_dir)
            return project(fn(Views(spark, sf_dir)), spec)

        run.__name__ = name
        JOBS[name] = run
        if sql is not None:
            _BODIES[name] = (sql, spec)
        return fn
    return register


def oracle_texts() -> dict[str, str]:
    """Complete SQL of every query that has one, built once all views are known."""
    return {name: _with_ctes(body, spec) for name, (body, spec) in _BODIES.items()}
