"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of so many splits or more is spread enough for any number of cores: it isn't shuffled for the sake of a few.
SPLITS = 64


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A small table of texts in as many tasks as there are cores: a small file may be one row group, and so one task."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, SPLITS) else df.repartition(cores)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows that are small but cost much, in a task for each core, whatever files and row groups they come from."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *key)
