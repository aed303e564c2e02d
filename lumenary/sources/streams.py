"""Streams over files, run to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def run_stream(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", at: str | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Read Parquet as a stream, transform, write every micro-batch as Parquet, and return what was written.

    Each batch goes to a folder of its own number, overwritten if the batch runs again, so the sink is exact once. Output and
    checkpoint lie below `at`, by default a new folder of the shared one; a second run with the same `at` goes on where the
    first one ended. `settings` of the session hold while the stream runs.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(path if not name.endswith(".parquet") or _is_folder(spark, path) else f"{folder}/{name[:-8]}[.]parquet", format="parquet")
    base = at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    result = build(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(result.schema).parquet(f"{base}/out/*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
