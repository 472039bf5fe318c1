"""Incremental ingestion of raw dumps (S1, S2, S7, S10 as a stream that stops when it has caught up).

The file source remembers which files it has read in its checkpoint, so each run takes the new ones
only, over all executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.session import settled_tables, settle
from faultline.sources import dumps
from faultline.sources.raw_json import component_items, field_samples, parse_records


def file_stream(spark: SparkSession, directory: str, files_per_trigger: int | None = None) -> DataFrame:
    """New dump files as a stream: their paths, and their content where a store can't be streamed."""
    columns = ["path"] if dumps.arrow_opens(directory) or directory.startswith("/") else ["path", "content"]
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(directory).select(*columns)


def ingest_new_files(spark: SparkSession, directory: str, out: str, checkpoint: str, files_per_trigger: int | None = None) -> None:
    """Read what is new, write samples to ``out/samples`` and what can't be read to ``out/quarantine``, then stop.

    Objects before a file's damage are kept, and so are objects that other text follows. Each batch goes to a directory of
    its own number, overwritten when a batch is repeated after a failure: nothing is stored twice.
    """
    def store(batch: DataFrame, number: int) -> None:
        with settled_tables():
            rows = settle(dumps.cut_files(batch.repartition(F.col("path")), strict=False), "objects")  # files are read once
            good, bad = parse_records(rows.filter("problem IS NULL").drop("problem", "position"), cut=True)
            samples = field_samples(component_items(good, keep=["source_file"]), keep=["source_file"])
            samples.write.mode("overwrite").parquet(f"{out}/samples/batch={number}")
            faulty = rows.filter("problem IS NOT NULL").select("source_file", "text", F.col("problem").alias("reason"))
            bad = bad.select("source_file", "text", F.lit("no record").alias("reason")).unionByName(faulty)
            bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    (
        file_stream(spark, directory, files_per_trigger)
        .writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
