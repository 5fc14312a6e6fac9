"""File-arrival ingestion with Structured Streaming.

The stream tracks *which files arrived* (a ``binaryFile`` source with the
content column pruned — no file bytes flow through it); each micro-batch
hands its bounded set of new paths to the batch ingest, which scans them
splittably. Exactly-once effect = checkpointed source offsets (at-least-once
delivery) + an idempotent sink and ledger (R3): a replayed micro-batch finds
its imports terminal and does nothing. A poison file ends FAILED with a
reason and never fails the micro-batch; a file that cannot be read is tried
once more and then fails alone (R4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerline import contract as C
from ledgerline.plans.ingest import ingest
from ledgerline.sources.csvscan import literal_path

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start_ingest_stream(spark: SparkSession, watch_dir: str, root: str, checkpoint: str,
                        batch_size: int = C.BATCH_SIZE_DEFAULT,
                        max_chars: int = C.MAX_RECORD_CHARS_DEFAULT,
                        max_files_per_trigger: int | None = 2,
                        max_bytes_per_trigger: int | None = None,
                        available_now: bool = False,
                        processing_time: str = "10 seconds",
                        archive_dir: str | None = None,
                        reports: list | None = None) -> StreamingQuery:
    """One import per arriving file; a micro-batch takes at most
    ``max_files_per_trigger`` files or, instead, files of about
    ``max_bytes_per_trigger`` bytes (a larger file goes alone). K6: with
    ``archive_dir`` processed inputs are moved away by the source after their
    batch commits."""
    if max_files_per_trigger is not None and max_bytes_per_trigger is not None:
        raise ValueError("a micro-batch is bounded by files or by bytes, not by both")
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", "true"))
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    arrivals = reader.load(watch_dir).select("path", "length", "modificationTime")

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        paths = [literal_path(r["path"]) for r in batch.select("path").collect()]  # bounded by the trigger
        if not paths:
            return
        # a fresh attempt id per delivery: a replayed epoch never reuses the
        # folder of an uncommitted (crashed) attempt
        report = ingest(spark, paths, root, batch_size=batch_size, max_chars=max_chars)
        if reports is not None:
            reports.append(report)

    writer = arrivals.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
