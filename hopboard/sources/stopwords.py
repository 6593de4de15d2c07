"""Stop-list table from a database over JDBC or from parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Table and columns of the stop-list.
STOPWORD_TABLE = "stop_words"
STOPWORD_SCHEMA = "word STRING, created_at TIMESTAMP"


def jdbc_options(url: str, table: str = STOPWORD_TABLE, **extra: str) -> dict[str, str]:
    """Reader and writer options; `extra` takes user, password, driver and the like."""
    return {"url": url, "dbtable": table, **extra}


def read_jdbc(spark: SparkSession, options: dict[str, str], predicates: list[str] | None = None) -> DataFrame:
    """The table by one connection, or by one for each predicate; the predicates must cover each row once."""
    if predicates is None:
        return spark.read.format("jdbc").options(**options).load().select("word", "created_at")
    options = dict(options)
    url, table = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, table, predicates=predicates, properties=options).select("word", "created_at")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STOPWORD_SCHEMA).parquet(path)
