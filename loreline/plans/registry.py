"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.plans.bindings import Inputs, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of `Inputs`. `sql` is a SELECT, or more WITH entries led by a comma."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            if views:
                text = f"{cte(*views)}\n{text}"
            elif text.startswith(","):
                text = "WITH " + text[1:]
            ORACLES[name] = text
        return fn

    return register


def clock(c):
    """Timestamps of results as text, which both engines print alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def six(c):
    """Doubles of results at six digits, no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def in_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
