"""Incremental runs: new URL files are processed as they arrive, whole sites at a time.

A micro-batch holds complete sites, so the plan is the batch plan and needs no state, watermark or window; progress
is the stream's checkpoint, and stopping the query keeps what is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.contact_facts import contact_facts
from ..scratch import cleared


def facts_stream(spark: SparkSession, sites_path: str, store: DataFrame, out_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a query over Parquet files of sites (``site_ord``, ``url``); appends facts; ends when all is read."""
    sites = spark.readStream.schema("site_ord int, url string").parquet(sites_path)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again overwrites its own folder; its scratch tables go with it
        with cleared(batch.sparkSession):
            contact_facts(batch, store, **options).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return sites.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
