"""The supplied tables seen as search events, stop-list and change log.

The event table has clean values only. Fixed rules on the event id add blanks, capitals, missing
fields, over-long texts and broken JSON, so that every outcome occurs; no row is left out.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.functions.messages import encode_event
from hopboard.operators.ingest import accepted, classify
from hopboard.operators.pruning import in_window
from hopboard.params import BoardParams

AS_OF = datetime(2024, 1, 20, 12, 34, 56, tzinfo=timezone.utc)
PARAMS = BoardParams.of(timedelta(days=7), bucket_count=28, top_k=20, counter="exact")
EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis_of(ts: Column) -> Column:
    """Epoch milliseconds of a zoneless timestamp taken as UTC, whatever the session's zone."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MILLISECOND", epoch, ts)


def search_events(table: DataFrame) -> DataFrame:
    """Typed search events; `well_formed` is false where the JSON form of the event is broken."""
    event_id = F.col("event_id")
    number = (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")
    kind = F.col("event_type")
    query = (
        F.when(event_id % 19 == 0, "   ")
        .when(event_id % 23 == 0, "")
        .when(event_id % 29 == 0, "я" * 257)
        .when(event_id % 7 == 0, F.concat(F.lit("  "), F.upper(kind), F.lit("\t "), number, F.lit(" ")))
        .when(event_id % 11 == 0, F.concat(F.upper(kind), F.lit("  "), number))
        .otherwise(F.concat(kind, F.lit(" "), number))
    )
    return table.select(
        query.alias("query"),
        F.when(event_id % 31 == 0, "").otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("source"),
        F.when(event_id % 37 == 0, F.lit(0)).otherwise(millis_of(F.col("ts"))).cast("bigint").alias("ts_ms"),
        event_id.cast("string").alias("event_id"),
        (event_id % 41 != 0).alias("well_formed"),
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.col("value").alias("weight"),
        F.col("event_type").alias("kind"),
    )


def messages(table: DataFrame) -> DataFrame:
    """JSON text of every event, with the row's id and its own time."""
    value = F.when(F.col("well_formed"), encode_event()).otherwise("{bad")
    return search_events(table).select("id", "ts", value.alias("value"))


def odd_messages(table: DataFrame) -> DataFrame:
    """JSON texts that test the strictness of decoding, one kind of oddity for each remainder by 21."""
    event = search_events(table)
    kind = F.col("id") % 21
    text = F.concat
    query = F.concat(F.lit('"query":"'), F.col("kind"), F.lit('"'))
    source = F.concat(F.lit(',"source":"user-'), F.col("id").cast("string"), F.lit('"'))
    time = F.concat(F.lit(',"ts_ms":'), F.col("ts_ms").cast("string"))
    plain = text(F.lit("{"), query, source, time, F.lit("}"))

    def with_more(more: str) -> Column:
        return text(F.lit("{"), query, source, time, F.lit(more + "}"))

    value = (
        F.when(kind == 0, plain)
        .when(kind == 1, with_more(',"event_id":5'))
        .when(kind == 2, with_more(',"query":"later"'))
        .when(kind == 3, with_more(',"query":null'))
        .when(kind == 4, with_more(',"extra":{"a":[1,2.5,true]}'))
        .when(kind == 5, text(plain, F.lit(" trailing")))
        .when(kind == 6, text(plain, F.lit(","), plain))
        .when(kind == 7, text(plain, F.lit("],["), plain))
        .when(kind == 8, F.replace(plain, F.lit('"'), F.lit("'")))
        .when(kind == 9, text(F.lit("{"), query, source, F.lit(',"ts_ms":"1"}')))
        .when(kind == 10, text(F.lit("{"), query, source, F.lit(',"ts_ms":1.0}')))
        .when(kind == 11, F.replace(F.replace(plain, F.lit("query"), F.lit("QUERY")), F.lit("ts_ms"), F.lit("Ts_Ms")))
        .when(kind == 12, text(F.lit('{"query":7'), source, time, F.lit("}")))
        .when(kind == 13, F.replace(plain, F.lit("user-"), F.lit("\\u0075ser\\t")))
        .when(kind == 14, F.lit("null"))
        .when(kind == 16, with_more(',"extra":{"a":1,"a":2}'))
        .when(kind == 17, with_more(',"extra":[{"a":1,"a":{"b":2,"b":3}}]'))
        .when(kind == 18, F.replace(plain, F.lit("user-"), F.lit("\\ud800x\\udc00\\ud83d\\ude00-")))
        .when(kind == 19, F.replace(plain, F.lit("user-"), F.lit("\\\\ud800-")))
        .when(kind == 20, F.replace(plain, F.lit("user-"), F.unhex(F.lit("75E28262")).cast("string")))
        .otherwise(F.replace(plain, F.lit(","), F.lit(" ,\n")))
    )
    return event.select("id", value.alias("value"))


def window_rows(
    spark: SparkSession, sf_dir: str, params: BoardParams = PARAMS, as_of: datetime = AS_OF
) -> DataFrame:
    """Accepted rows of one window. The scan is limited to the window's time range."""
    events = search_events(in_window(read_table(spark, sf_dir, "events"), params, as_of))
    return accepted(classify(events, params, as_of))


def stored_stopwords(events: DataFrame) -> DataFrame:
    """Stop-list table: the texts of error events as typed, each with the time it first occurs."""
    return (
        search_events(events.where(F.col("event_type") == "error"))
        .groupBy(F.col("query").alias("word"))
        .agg(F.min("ts").alias("created_at"))
    )


def stopword_changes(events: DataFrame) -> DataFrame:
    """Change log: every event adds its text, or removes it where its weight is 20 or more."""
    op = F.when(F.col("weight") >= 20, "remove").otherwise("add")
    return search_events(events).select(
        F.col("id").alias("seq"), op.alias("op"), F.col("query").alias("word"), F.col("ts").alias("changed_at")
    )


def query_names(rows: DataFrame) -> DataFrame:
    """Names that queries stand under, as typed: a long chain, a circle, and one name for many.

    Each view stands under the one before it, each error under the next one round, clicks under every tenth.
    """
    kind, number = F.split_part("query", F.lit(" "), F.lit(1)), F.split_part("query", F.lit(" "), F.lit(2)).cast("int")
    target = (
        F.when((kind == "view") & (number > 0), number - 1)
        .when(kind == "error", (number + 1) % 20)
        .when(kind == "click", F.floor(number / 10) * 10)
    )
    typed = F.concat(F.lit(" "), F.upper(kind), F.lit("  "), target.cast("string"))
    return rows.select("query").distinct().select("query", typed.alias("canonical")).where("canonical IS NOT NULL")
