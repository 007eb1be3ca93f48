"""Incremental ingestion: documents arrive as files; each batch is processed whole and overwrites its documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet", **options: str) -> StreamingQuery:
    """Reads new files under source, applies transform to each batch and appends it to target by batch.

    Documents are independent, so there is no state and no watermark. A batch that
    is run again after a failure replaces its own folder; readers take the latest
    batch of each document (see latest).
    """

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.format(fmt).schema(schema).options(**options).load(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    """The rows of the last batch in which each document came."""
    rows = spark.read.parquet(target)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi")
