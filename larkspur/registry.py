"""A query and the SQL that must give the same rows, registered together."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import ship, table

NAMED = re.compile(r"\{(\w+)\}")
Build = Callable[[SparkSession, str], DataFrame]


def _shipped(build: Build) -> Build:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return build(spark, folder)

    return run


@dataclass
class Registry:
    queries: dict[str, Build] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, oracle: str | None = None) -> Callable[[Build], Build]:
        """Decorator: register ``build(spark, folder)`` as ``name``."""

        def register(build: Build) -> Build:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = _shipped(build)
            if oracle is not None:
                self.oracles[name] = oracle
            return build

        return register

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """Register a query given as Spark SQL in which ``{table}`` names a table of the
        data folder; ``oracle`` defaults to the same text."""
        tables = sorted(set(NAMED.findall(text)))

        def build(spark: SparkSession, folder: str) -> DataFrame:
            return spark.sql(text, **{t: table(spark, folder, t) for t in tables})

        self.add(name, oracle if oracle is not None else NAMED.sub(r"\1", text))(build)
