"""Incremental ingest (an extension): MIDI files that arrive in a folder become event rows.

The reference behaviour is a batch listing; there is no event time, so no watermark is used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from notewright.sources import midi

#: Buckets of paths, each with a counter of its own: as many tasks number at once. A stream keeps the
#: number that it began with.
BUCKETS = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "path string, content binary, song long, again boolean"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, content) of *.mid and *.MID files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.{mid,MID}")
    return reader.option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path", "content")


def decode_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Decodes what has arrived and ends; each file is decoded once, whatever the restarts."""
    decoded = midi.read_events(arriving_files(spark, folder))
    writer = decoded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


class SongNumbers(StatefulProcessor):
    """Keeps, for a bucket of paths, each path's song number and how many there are. Bucket b of n gives
    the numbers b, b + n, b + 2n, ..., so no two buckets give the same."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.known = handle.getMapState("known", "path string", "song long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            songs, again = [], []
            for path in frame["path"]:
                again.append(self.known.containsKey((path,)))
                if not again[-1]:
                    self.known.updateValue((path,), (int(key[0]) + self.buckets * n,))
                    n += 1
                songs.append(self.known.getValue((path,))[0])
            yield pd.DataFrame({"path": frame["path"], "content": frame["content"], "song": songs, "again": again})
        self.count.update((n,))

    def close(self) -> None:
        pass


def numbered_files(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(path, content, song, again) of a stream of (path, content): song is a lasting number, the same
    whenever a path comes again (then again is true). Numbers live in the query's state, so a restart
    from its checkpoint goes on with them; they are unique but not without gaps. Paths are dealt by hash
    into buckets, whose state grows by a path and a number a file."""
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = files.where(F.col("path").isNotNull()).select(bucket, "path", "content").groupBy("bucket")
    return dealt.transformWithStateInPandas(statefulProcessor=SongNumbers(buckets), outputStructType=NUMBERED, outputMode="Append", timeMode="None")


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, *, files_per_trigger: int = 1000, buckets: int = BUCKETS) -> StreamingQuery:
    """Numbers and decodes what has arrived and ends. Each batch is two folders below out, events (a
    row an event, with song and path) and rejects (path, song and why); a batch that runs again replaces
    what it wrote before, so every file is there once, whatever the restarts."""
    numbered = numbered_files(arriving_files(spark, folder, files_per_trigger), buckets)

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.where("not again").persist()
        songs = fresh.select("path", "song")
        decoded = midi.read_events(fresh).join(songs, "path").persist()
        events = decoded.where("status = 'ok'").select("song", "path", "resolution", F.inline("events"))
        events.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        decoded.where("status <> 'ok'").select("song", "path", "status").write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        decoded.unpersist()
        fresh.unpersist()

    writer = numbered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start()
