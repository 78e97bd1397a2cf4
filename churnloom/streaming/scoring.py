"""Scoring records as files of them arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from churnloom.operators.score import score
from churnloom.schema import customer_schema
from churnloom.sources.storage import passing_scratch

BATCH_COLUMN = "batch_id"


def score_stream(
    spark: SparkSession,
    model: PipelineModel,
    source: str,
    sink: str,
    checkpoint: str,
    fmt: str = "json",
    schema: T.StructType | None = None,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Score every new file below ``source`` into ``sink``, then stop when none is left.

    The batches run through ``foreachBatch`` because imputation looks neighbours up
    with joins and windows. Each batch owns the folder of its number and replaces it,
    so a batch that is run again after a failure leaves no duplicate.
    """
    records = (
        spark.readStream.schema(schema or customer_schema(raw=True, target=False))
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(source)
    )

    def write_batch(batch: DataFrame, number: int) -> None:
        # Imputation reads the batch several times, and its tables are of use to no other batch.
        batch = batch.persist()
        try:
            with passing_scratch(spark):
                score(model, batch).write.mode("overwrite").parquet(
                    f"{sink}/{BATCH_COLUMN}={number}"
                )
        finally:
            batch.unpersist()

    return (
        records.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
