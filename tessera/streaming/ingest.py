"""Revisions as a stream: newer batches replace what a unit observed before; a late revision changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canon
from ..sources import snapshot
from ..sources.scratch import table


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """Applies revision files (id, tu_id, seen_at, ...) below source to the snapshot at target until none is left.

    Each micro-batch publishes a new version with one row per unit, the newest by (seen_at, id). A batch run again after a
    failure gives the same version's rows, so the stream may stop and resume anywhere.
    """

    def apply(batch: DataFrame, _: int) -> None:
        try:
            batch = batch.unionByName(snapshot.load(batch.sparkSession, target)["revisions"])
        except snapshot.NoSnapshot:
            pass  # the first batch; a snapshot of another schema stops the stream
        batch = table(batch, "batch")
        newest = canon.active_revisions(batch).select(F.col("revision_id").alias("id"))
        snapshot.checkpoint({"revisions": table(batch.join(newest, "id", "left_semi").dropDuplicates(["id"]), "newest")}, target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
