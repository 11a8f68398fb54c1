"""Registry tying a query name to its Spark plan and its independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import Tables, adapter_ctes
from ..functions.frames import rounded, wide_integers

Plan = Callable[[Tables], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} registered twice")
        PLANS[name] = plan
        if oracle is not None:
            ORACLES[name] = adapter_ctes(oracle)
        return plan

    return register


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return rounded(wide_integers(plan(Tables(spark, sf_dir))))

    return run
