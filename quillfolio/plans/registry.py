"""Named queries over the test tables: what the entry module and bench run."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.testtables import TestTables
from .present import present


@dataclass(frozen=True)
class Query:
    spec: str
    build: Callable[[TestTables], DataFrame]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(TestTables(spark, sf_dir)), self.spec)


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str):
    def register(build: Callable[[TestTables], DataFrame]):
        QUERIES[name] = Query(spec, build)
        return build

    return register
