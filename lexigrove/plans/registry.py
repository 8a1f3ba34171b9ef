"""Registry of named queries: a Spark plan and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.session import table

Plan = Callable[["Tables"], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of a folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"two queries are named {name!r}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lexigrove.plans import analysis, code, corpora, relational, retrieval, stores, studies, trees  # noqa: F401

    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
