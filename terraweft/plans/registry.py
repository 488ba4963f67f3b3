"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.plans.fixtures import Fixtures, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


# Engines add in different orders. Rounding with a shifted boundary keeps values like 0.00005 clear of it.
SHIFT = 0.000017


def near(col: Column | str) -> Column:
    """A large floating-point result in comparable form; twins write ``near(expression)``."""
    return F.round((F.col(col) if isinstance(col, str) else col) + SHIFT, 4)


def _expand(sql: str) -> str:
    while (at := sql.find("near(")) >= 0:
        depth, end = 0, at + 4
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        sql = f"{sql[:at]}round(({sql[at + 5 : end]}) + {SHIFT}, 4){sql[end + 1 :]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register a function of the fixtures as query ``name``, with its SQL twin if there is one."""

    def add(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        if sql is not None:
            TWINS[name] = _expand(twin(sql))
        return build

    return add
