"""Catalogue of registered queries: key -> (DataFrame builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paramo.plans.bindings import binding, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass
class Inputs:
    """Bound inputs of one run: ``i("b_toll")`` is the binding as a DataFrame."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return binding(self.spark, self.sf_dir, name)


def query(key: str, oracle: str | None = None, uses: str = ""):
    """Register a builder ``f(inputs) -> DataFrame`` under ``key``; ``uses`` names the bindings
    that precede the oracle statement."""

    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if oracle is not None:
            names = uses.split()
            ORACLES[key] = with_bindings(oracle, *names) if names else oracle.strip()
        return build

    return add
