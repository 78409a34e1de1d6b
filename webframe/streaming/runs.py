"""Sources with admission control, and runs up to the end of the data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webframe.sources.staging import Workspace, setting


def admit(
    spark: SparkSession,
    path: str,
    schema,
    max_bytes: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Stream of a Parquet table, a file or a folder of part files, so many bytes or files per micro-batch.

    With a processing-time trigger of one second ``max_bytes`` bounds the bytes
    taken in per second. Files come in the order they were written, which need
    not be the order of event time: limits together with a watermark need a
    delay that covers the files of several batches.
    """
    reader = spark.readStream.schema(schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # A stream reads folders; of the one this file lies in it takes just the file.
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").parquet(path)


class LateRows(RuntimeError):
    """Rows came after the watermark had passed them, so the result is not whole."""


@dataclass
class Progress:
    """What the batches of a run have reported, each counted once, however many there are."""

    batches: dict[int, dict] = field(default_factory=dict)

    def note(self, query: StreamingQuery) -> None:
        for p in query.recentProgress:
            states = p.stateOperators
            self.batches[p.batchId] = {
                "rows": p.numInputRows, "late": sum(s.numRowsDroppedByWatermark for s in states),
                "kept": sum(s.numRowsTotal for s in states), "removed": sum(s.numRowsRemoved for s in states),
            }

    def total(self, what: str) -> int:
        return sum(b[what] for b in self.batches.values())


#: State in files of the executors and the shared folder instead of the memory of the executors.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_POLL = 0.1


class Run:
    """A stream run over all data there is, into Parquet files of the shared folder.

    Progress, state and output lie in one folder, so a run that was stopped goes on where it was when ``folder`` is given
    again, on other executors too; the output of a batch that was not finished is replaced. With ``store=ROCKSDB`` state
    may outgrow the memory of the executors.
    """

    def __init__(self, name: str, mode: str = "append", folder: str | None = None, store: str | None = None):
        self.name, self.mode, self.folder, self.store, self.progress = name, mode, folder, store, Progress()

    def run(self, stream: DataFrame, stop_after: int | None = None) -> DataFrame:
        """Runs until the data ends, or until so many batches are done; returns what is written so far.

        Nothing goes through the driver. Batches of an update stream are kept apart by ``batch_id``. Rows
        dropped as late are an error, not a smaller result.
        """
        spark = stream.sparkSession
        self.folder = self.folder or Workspace(spark, self.name).path
        target = f"{self.folder}/out"
        writer = stream.writeStream.option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True)
        with setting(spark, "spark.sql.streaming.stateStore.providerClass", self.store):
            if self.mode == "append":
                query = writer.format("parquet").outputMode("append").start(target)
            else:

                def save(batch: DataFrame, batch_id: int) -> None:
                    batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

                query = writer.outputMode(self.mode).foreachBatch(save).start()
            before = len(self.progress.batches)
            while not query.awaitTermination(_POLL):
                self.progress.note(query)
                if stop_after is not None and len(self.progress.batches) - before >= stop_after:
                    query.stop()
        self.progress.note(query)
        if late := self.progress.total("late"):
            raise LateRows(f"{self.name}: {late} rows were late")
        return self.output(spark, stream.schema)

    def output(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        kept = [T.StructField(f.name, f.dataType) for f in schema]
        if self.mode != "append":
            kept.append(T.StructField("batch_id", T.LongType()))
        return spark.read.schema(T.StructType(kept)).parquet(f"{self.folder}/out")


def run_available(stream: DataFrame, name: str, mode: str = "append", store: str | None = None) -> DataFrame:
    """Run a stream over all data there is, and read what it wrote; see :class:`Run`."""
    return Run(name, mode, store=store).run(stream)


def last_updates(updates: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key of an update stream, open windows included."""
    rest = [c for c in updates.columns if c not in (*key, "batch_id")]
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last"))
    return last.select(*key, "_last.*")
