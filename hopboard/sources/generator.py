"""Synthetic search events, made by Spark tasks from row numbers, as a table or a stream.

Values depend on the row number and seed only, so a repeated task makes the same rows again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.params import epoch_micros

# Queries and source names of the generated streams.
MIX_QUERIES = [
    "слайм", "sixseven", "лабубу", "сквиш", "поп ит", "стикеры", "брелок", "плюшевая игрушка", "кукла",
    "конструктор", "тамагочи", "шоппер", "худи", "кроксы", "бисер", "набор для творчества", "антистресс", "пенал",
]
ORGANIC_QUERIES = ["слайм", "sixseven", "лабубу", "стикеры"]
FLOOD_QUERY = "накрутка"
FLOOD_SOURCE = "bot-account"
SPREAD_SECONDS = 300


def fixed_query(spark: SparkSession, query: str, n: int, sources: int, now: datetime) -> DataFrame:
    """One query from a number of sources in turn; zero or more sources than rows means one each."""
    return fixed_events(spark.range(n), query, n if sources <= 0 or sources > n else sources, now)


def bot_flood(spark: SparkSession, now: datetime, flood: int = 1000, organic: int = 200, seed: int = 0) -> DataFrame:
    """One source repeating one query over five minutes, plus a little ordinary traffic."""
    return flood_events(spark.range(flood + organic), now, flood, seed)


def query_mix(spark: SparkSession, n: int, now: datetime, seed: int = 0) -> DataFrame:
    return mix_events(spark.range(n), now, seed)


def fixed_events(numbers: DataFrame, query: str, sources: int, now: datetime) -> DataFrame:
    """Event of each number `id`: one query from `sources` sources in turn."""
    source = F.concat(F.lit("e2e-user-"), (F.col("id") % sources).cast("string"))
    return _events(numbers, F.lit(query), source, F.lit(_millis(now)))


def flood_events(numbers: DataFrame, now: datetime, flood: int = 1000, seed: int = 0) -> DataFrame:
    """Event of each number `id`: those below `flood` are the bot's, the rest ordinary traffic."""
    bot = numbers.where(F.col("id") < flood)
    users = numbers.where(F.col("id") >= flood).select((F.col("id") - flood).alias("id"))
    return _events(bot, F.lit(FLOOD_QUERY), F.lit(FLOOD_SOURCE), _spread(now, seed)).unionByName(
        _events(users, _one_of(ORGANIC_QUERIES, seed + 1), _user(5_000, seed + 2), _spread(now, seed + 3))
    )


def mix_events(numbers: DataFrame, now: datetime, seed: int = 0) -> DataFrame:
    return _events(numbers, _one_of(MIX_QUERIES, seed), _user(10_000, seed + 1), _spread(now, seed + 2))


def numbers_stream(spark: SparkSession, rows_per_batch: int, partitions: int = 1) -> DataFrame:
    """Row numbers `id` as a stream that goes on from its checkpoint: batch after batch of so many numbers.

    A batch that is run again has the same numbers, and so the same events.
    """
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", partitions)
    return stream.load().select(F.col("value").alias("id"))


def _events(numbers: DataFrame, query: Column, source: Column, ts_ms: Column) -> DataFrame:
    return numbers.select(
        query.alias("query"),
        source.alias("source"),
        ts_ms.cast("bigint").alias("ts_ms"),
        F.lit(None).cast("string").alias("event_id"),
    )


def _draw(bound: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bound)).cast("int")


def _one_of(values: list[str], seed: int) -> Column:
    return F.get(F.array(*[F.lit(value) for value in values]), _draw(len(values), seed))


def _user(bound: int, seed: int) -> Column:
    return F.concat(F.lit("user-"), _draw(bound, seed).cast("string"))


def _spread(now: datetime, seed: int) -> Column:
    return F.lit(_millis(now)) - _draw(SPREAD_SECONDS, seed).cast("bigint") * 1000


def _millis(now: datetime) -> int:
    return epoch_micros(now) // 1000
