"""Incremental loading with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistle.sources import eml
from epistle.sources.archive import Archive


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="epistle-stream-")
    return f"{base.rstrip('/')}/epistle-stream/{name}-{uuid.uuid4().hex}"


def ingest_available(spark: SparkSession, folder: str, archive: Archive, checkpoint: str, files_per_batch: int = 100, registry: DataFrame | None = None,
                     owners: list[str] | None = None, encoder=None, dims: int = 384) -> int:
    """Load the files below a folder that the checkpoint does not know yet; returns the number of batches.

    A batch is deduplicated against the archive before it is written, so a batch that runs again
    after a failure adds nothing twice; its errors replace those it wrote before. Files that can't be parsed go to the
    table errors. owners: the addresses whose messages are outbound; with an encoder, quotes much like another of their thread go."""
    schema = spark.read.format("binaryFile").load(folder).schema
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    batches = []

    def write(batch: DataFrame, number: int) -> None:
        parsed = eml.parse(batch.select("path", "content")).persist()
        stored = archive.messages() if archive.exists("messages") else None
        archive.append(eml.messages(parsed, registry=registry, stored=stored, owners=owners, encoder=encoder, dims=dims))
        archive.store_attachments(eml.attachment_contents(batch))
        parsed.where("error IS NOT NULL").select("source_path", "error").write.mode("overwrite").parquet(f"{archive.path}/errors/batch={number}")
        parsed.unpersist()
        batches.append(number)

    run = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return len(batches)


def pending(spark: SparkSession, folder: str, archive: Archive) -> DataFrame:
    """Files below a folder that are not in the archive: what a batch job has left to do."""
    found = eml.files(spark, folder)
    if not archive.exists("messages"):
        return found
    return found.join(archive.messages().select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")


def error_types(archive: Archive) -> DataFrame:
    """How many files failed with each type of error."""
    errors = archive._read("errors")
    return errors.groupBy(F.split_part("error", F.lit(":"), F.lit(1)).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def events_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: each event once, counted by type when all there is has been read."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = scratch(spark, "events")
    # a file source reads folders: the file is named by a pattern of its folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path.replace("events.parquet", "events*.parquet"))
    once = stream.select("event_id", "event_type").dropDuplicates(["event_id"])
    once.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type of a stream with event times, late events within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
