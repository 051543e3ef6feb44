"""New files of a folder as they come, each batch through the ingestion job."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..ingest import Settings, run_ingest
from ..schemas import FIELDS
from ..sources.files import number_rows


def ingest_new_files(spark: SparkSession, store, settings: Settings, folder: str, checkpoint: str):
    """Ingest all CSV files that earlier calls haven't seen, then stop. The checkpoint tracks files, the mark event time.

    A batch that is run again after a crash upserts the same rows.
    """
    # Multi-line, for quoted fields may hold line breaks; a task reads a whole file.
    raw = spark.readStream.schema(", ".join(f"{f} string" for f in FIELDS)).options(header=True, escape='"', multiLine=True).csv(folder)

    def load(batch, batch_id: int) -> None:
        run_ingest(spark, store, settings, raw=number_rows(batch), run_id=f"batch-{batch_id}")

    query = raw.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
