"""A named set of queries, each with an optional oracle text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weftgraph.session import tune
from weftgraph.sources import views


class Book:
    def __init__(self) -> None:
        self.runs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.texts: dict[str, str] = {}

    def query(self, oracle: str | None = None):
        def register(fn: Callable[[SparkSession, str], DataFrame]):
            @wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(tune(spark), sf_dir)

            self.runs[fn.__name__] = run
            if oracle is not None:
                self.texts[fn.__name__] = oracle
            return fn

        return register


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.EDGES_ONCE)


def one_column(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A small request table, such as the symbols a user asks for."""
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


GRAPH = f"nodes AS {views.duck(views.NODES)}, edges AS MATERIALIZED {views.duck(views.EDGES)}"
