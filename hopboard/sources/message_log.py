"""Messages with partitions and offsets in plain files: a source that can be scripted, restarted and asked what it has done.

A log is a folder of segments, each written once and complete when its list of ends is there. A message has a
partition, from the hash of its number, and the next offset in it. The stream reads ranges of offsets, which give the
same messages each time, so a failed batch is delivered again as it was. Offsets count bad messages like good ones:
what has been committed is read from the checkpoint of the query, as the end of its last complete batch.

Files are opened by the Python workers of the source, so the folder must be one that pyarrow can open on all executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from hopboard.sources.storage import matching_paths

FORMAT = "message_log"
MESSAGE = "value string, partition int, offset bigint"

# Fixed value: file that lists the end of every partition after a segment. Spark does not read names with this first letter.
_ENDS = "_ends.json"

Offsets = dict[str, int]


def append_messages(messages: DataFrame, path: str, number: str, partitions: int) -> Offsets:
    """Write the next segment: `value` of the messages in the order of a unique column; returns the new ends.

    The number of partitions is that of the first segment from then on. One writer at a time.
    """
    file_system, root = fs.FileSystem.from_uri(path)
    done = _segments(file_system, root)
    ends = dict(done[-1][1]) if done else {str(p): 0 for p in range(partitions)}
    partition = F.pmod(F.xxhash64(number), F.lit(len(ends))).cast("int")
    starts = F.create_map(*[F.lit(value) for p, end in ends.items() for value in (int(p), end)])
    place = F.row_number().over(Window.partitionBy("partition").orderBy(number)) - 1
    numbered = messages.select(F.col("value"), F.col(number), partition.alias("partition")).select(
        "value", "partition", (place + F.element_at(starts, F.col("partition"))).cast("bigint").alias("offset")
    )
    segment = f"segment={len(done):06d}"
    numbered.write.mode("overwrite").partitionBy("partition").parquet(f"{path.rstrip('/')}/{segment}")
    written = messages.sparkSession.read.schema(MESSAGE).parquet(f"{path.rstrip('/')}/{segment}")
    for row in written.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect():
        ends[str(row["partition"])] += row["n"]
    with file_system.open_output_stream(f"{root}/{segment}/{_ENDS}") as file:
        file.write(json.dumps(ends).encode())
    return ends


def _segments(file_system: fs.FileSystem, root: str) -> list[tuple[str, Offsets]]:
    """Complete segments in order, with the ends after each."""
    found = file_system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    segments = []
    for folder in sorted(info.path for info in found if info.type == fs.FileType.Directory and "/segment=" in info.path):
        ends = f"{folder}/{_ENDS}"
        if file_system.get_file_info(ends).type == fs.FileType.File:
            with file_system.open_input_stream(ends) as file:
                segments.append((folder, json.loads(file.read())))
    return segments


@dataclass
class OffsetRange(InputPartition):
    partition: int
    start: int
    stop: int


class MessageLogSource(DataSource):
    """Stream over a log: option `path`, and `rowsPerTask` for the most messages that one task reads."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> MessageLogReader:
        return MessageLogReader(self.options["path"], int(self.options.get("rowsPerTask", 1_000_000)))


class MessageLogReader(DataSourceStreamReader):
    def __init__(self, path: str, rows_per_task: int) -> None:
        self.path = path
        self.rows_per_task = rows_per_task

    def initialOffset(self) -> Offsets:
        return {}

    def latestOffset(self) -> Offsets:
        segments = _segments(*fs.FileSystem.from_uri(self.path))
        return segments[-1][1] if segments else {}

    def partitions(self, start: Offsets, end: Offsets) -> Sequence[OffsetRange]:
        return [
            OffsetRange(int(p), first, min(first + self.rows_per_task, stop))
            for p, stop in sorted(end.items())
            for first in range(start.get(p, 0), stop, self.rows_per_task)
        ]

    def read(self, partition: OffsetRange) -> Iterator[pa.RecordBatch]:
        file_system, root = fs.FileSystem.from_uri(self.path)
        before = 0
        for folder, ends in _segments(file_system, root):
            first, before = before, ends[str(partition.partition)]
            if first < partition.stop and partition.start < before:
                files = ds.dataset(f"{folder}/partition={partition.partition}", filesystem=file_system, format="parquet")
                wanted = (pc.field("offset") >= partition.start) & (pc.field("offset") < partition.stop)
                for batch in files.to_batches(columns=["value", "offset"], filter=wanted):
                    number = pa.array([partition.partition] * batch.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch["value"], number, batch["offset"]], ["value", "partition", "offset"])


def read_log(spark: SparkSession, path: str, rows_per_task: int | None = None) -> DataFrame:
    """Stream of the messages of a log (value, partition, offset)."""
    spark.dataSource.register(MessageLogSource)
    reader = spark.readStream.format(FORMAT).option("path", path)
    return (reader.option("rowsPerTask", rows_per_task) if rows_per_task else reader).load()


def committed_offsets(spark: SparkSession, checkpoint: str) -> Offsets:
    """Ends of the last batch that a query over one log has completed; none before the first."""
    done = [int(path.rsplit("/", 1)[1]) for path in matching_paths(spark, f"{checkpoint}/commits/[0-9]*")]
    if not done:
        return {}
    lines = spark.read.text(f"{checkpoint}/offsets/{max(done)}", wholetext=True).first()[0].splitlines()
    return json.loads(lines[-1])
