"""Continuous ingestion: files that appear in a folder are upserted batch by batch (an extension; searches see each batch
once it is committed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import Config
from ..sources import files as FS
from ..sources.store import Store


def watch(store: Store, folder: str, checkpoint: str, config: Config, tag: str | None = None, source: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start ingesting a folder. A batch that is run again after a failure upserts the same rows, so nothing comes twice."""
    files = store.spark.readStream.format("binaryFile").schema(FS.FILES).option("recursiveFileLookup", True).load(folder)

    def upsert(batch: DataFrame, _: int) -> None:
        path = F.regexp_replace("path", r"\A[a-z0-9]+:/+(?=[^/])", "/")
        rows = batch.select(path.alias("path"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("mtime"), F.col("length").alias("size"), "content")
        docs, _bad = FS.documents(rows, tag, source)
        store.upsert(docs, config)

    writer = files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
