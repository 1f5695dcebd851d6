"""Files that keep arriving: a stream of JSON documents, parsed batch by batch into good rows and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from goldrec.plans.config import Config
from goldrec.plans.engine import parse
from goldrec.sources.ats import from_files
from goldrec.sources.files import split_rejects


def stream_ats(spark: SparkSession, path: str, good: str, rejects: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Starts a query that takes all files there now, and on a restart only those that have come since.

    Files pass the same gate as in a batch run. A batch that is repeated after a failure overwrites its own folder, so that no record is written twice.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    def batch(rows: DataFrame, number: int) -> None:
        fine, bad = split_rejects(from_files(rows))
        parse(fine, config).write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
