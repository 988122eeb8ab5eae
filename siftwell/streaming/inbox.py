"""An inbox folder: files that arrive are ingested once each, as a stream of batches.

A ledger in the store says which upload a file (its path and time) was taken as, and is written before the upload is. A batch
that is run again after a failure passes over files whose upload is complete, and takes the others anew in place of what was left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.service import Service
from ..sources.store import NotFound
from ..sources.uploads import UploadError

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(service: Service, folder: str, checkpoint: str, on_error: Callable[[str, Exception], None] | None = None, once: bool = True) -> StreamingQuery:
    """Ingests every new file of the folder. A file within the upload limit is one upload on the driver; a larger one is read by Spark.
    A file that is refused is reported and left; the others go on. With once, the stream ends when it has taken what is
    there."""
    store = service.store

    def taken_before(path: str, modified) -> bool:
        mine = store.table("inbox").where((F.col("path") == path) & (F.col("modified") == F.lit(modified)))
        done = False
        for row in mine.select("upload_id").collect():
            try:
                done = done or service.upload(row[0])["status"] == "completed"
                if not done:
                    service.delete_upload(row[0])
            except NotFound:
                continue
        return done

    def take(batch: DataFrame, _: int) -> None:
        small = F.when(F.col("length") <= service.max_bytes, F.col("content"))
        for row in batch.select("path", "modificationTime", small.alias("content")).toLocalIterator():  # one upload at a time, each within the upload limit
            if taken_before(row["path"], row["modificationTime"]):
                continue
            begun = lambda upload_id, row=row: store.insert("inbox", "inbox_id", "taken_at", {"path": row["path"], "modified": row["modificationTime"], "upload_id": upload_id})
            try:
                if row["content"] is None:
                    service.ingest_folder(row["path"], begun=begun)
                else:
                    service.ingest(bytes(row["content"]), row["path"].rsplit("/", 1)[-1], begun)
            except UploadError as error:
                if on_error is not None:
                    on_error(row["path"], error)

    files = service.spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", 20).load(folder)
    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
