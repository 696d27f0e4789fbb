"""The table of registered queries: a Spark function and, where there is one, its SQL twin."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Given tables of one folder; ``t.orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Spread(Tables):
    """The tables of ``t``; rows of those named in ``keys`` are dealt over the tasks by their key, as a file of few row groups is read by few tasks."""

    def __init__(self, t: Tables, **keys: str):
        super().__init__(t.spark, t.folder)
        self.keys = keys

    def __getattr__(self, name: str) -> DataFrame:
        rows = super().__getattr__(name)
        return rows.repartition(self.keys[name]) if name in self.keys else rows


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return add
