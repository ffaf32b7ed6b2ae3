"""Linking vendor records as they arrive: a stream joined with a static reference list on blocking keys. An extension; the batch operators decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def candidates(arriving: DataFrame, reference_keys: DataFrame, keys: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """s1_id, vendor_id of arriving records. keys: a blocking strategy; reference_keys: the same strategy's keys of the reference list.

    A stream-static join keeps no state: the reference side is read anew for each batch.
    """
    a = reference_keys.select(F.col("entity_id").alias("s1_id"), "country", "key")
    return keys(arriving).withColumnRenamed("entity_id", "vendor_id").join(a, ["country", "key"]).select("s1_id", "vendor_id")


def link(arriving: DataFrame, reference_keys: DataFrame, keys: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends the distinct candidates of each batch to Parquet, once per batch even if it is replayed: a batch overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        candidates(batch, reference_keys, keys).distinct().write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
