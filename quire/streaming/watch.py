"""A folder as a stream of files: each is converted once it is at rest, its pages are appended, failures are tried again and
then kept as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import Limits, extension, extract

FILES = "path string, modificationTime timestamp, length long, content binary"
WAITING = "path string, modificationTime timestamp, length long, tries int"


def files(spark: SparkSession, inbox: str, glob: str = "*", archive: str | None = None, a_batch: int = 1000) -> DataFrame:
    """New files of a folder. With archive, files that are done move there in a later batch."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", a_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(inbox)


class Waiting:
    """Files that were too young, or that failed, in a table for each turn; a turn that runs twice replaces itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def turn(self, tag: str) -> tuple[int, str | None]:
        """(number of the turn with this tag, name of the one before)."""
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if self.fs.exists(self._path("")) else []
        names = [n for n in names if n.startswith("turn-")]
        if names and names[-1].split("-", 2)[2] == tag:
            return int(names[-1].split("-")[1]), names[-2] if len(names) > 1 else None
        return int(names[-1].split("-")[1]) + 1 if names else 1, names[-1] if names else None

    def read(self, name: str | None) -> DataFrame:
        return self.spark.read.schema(WAITING).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], WAITING)

    def now(self, rows: DataFrame) -> DataFrame:
        """The files of rows as they are now, with tries, and whether they are as they were; those that are gone are left out."""
        paths = [p for (p,) in rows.select("path").collect() if self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        if not paths:
            return self.spark.createDataFrame([], FILES + ", tries int, same boolean")
        seen = rows.select("path", F.col("modificationTime").alias("_m"), F.col("length").alias("_l"), "tries")
        there = self.spark.read.format("binaryFile").load(paths).join(seen, "path")
        return there.select("path", "modificationTime", "length", "content", "tries", ((F.col("modificationTime") == F.col("_m")) & (F.col("length") == F.col("_l"))).alias("same"))


def take(spark: SparkSession, new: DataFrame | None, out: str, waiting: Waiting, tag: str, clean: Callable[[DataFrame], DataFrame] | None, limits: Limits, settle: float, attempts: int) -> int:
    """Convert the new files and those that wait, as far as they are at rest; how many wait then.

    At rest is what hasn't changed for `settle` seconds, and not since it was seen before. A file whose conversion fails
    waits for the next turn, until it has failed `attempts` times; then its row says why.
    """
    k, before = waiting.turn(tag)
    rows = waiting.now(waiting.read(before))
    if new is not None:
        rows = rows.unionByName(new.select("path", "modificationTime", "length", "content").withColumns({"tries": F.lit(0), "same": F.lit(True)}))
    old = F.current_timestamp().cast("double") - F.col("modificationTime").cast("double") >= settle
    rows = rows.withColumn("ready", F.col("same") & old)
    ready = rows.where("ready").select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content", extension(F.col("path")).alias("format"))
    stage = f"{waiting.folder}/stage-{tag}"
    extract(ready, limits).write.mode("overwrite").parquet(stage)
    pages = spark.read.parquet(stage)
    again = pages.where(F.col("status").startswith("conversion failed")).select("path").distinct().join(rows.select("path", "modificationTime", "length", "tries"), "path").where(F.col("tries") + 1 < attempts)
    left = rows.where("not ready").select("path", "modificationTime", "length", "tries").union(again.select("path", "modificationTime", "length", F.col("tries") + 1))
    name = f"turn-{k:09d}-{tag}"
    left.write.mode("overwrite").parquet(f"{waiting.folder}/{name}")
    left = waiting.read(name)
    done = pages.join(left.select("path"), "path", "left_anti").select(pages.columns)
    (clean(done) if clean else done).write.mode("overwrite").parquet(f"{out}/batch={tag}")
    waiting.fs.delete(waiting._path(f"stage-{tag}"), True)
    return left.count()


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, glob: str = "*", clean: Callable[[DataFrame], DataFrame] | None = None, limits: Limits = Limits(), archive: str | None = None, once: bool = True, every: str = "1 second", settle: float = 0.0, attempts: int = 3) -> StreamingQuery:
    """Pages of new files to out, a folder for each batch, so that a batch that runs twice replaces itself.

    The checkpoint knows which files were seen; it takes the place of polling state. Files that are still written, or fail,
    wait beside it and are looked at again with the next batch, or by settle_waiting() where no new file comes. A file's
    digest goes with its rows, so the same content under two names can be found. once takes what there is and stops.
    """
    waiting = Waiting(spark, f"{checkpoint}-waiting")

    def batch(rows: DataFrame, n: int) -> None:
        take(spark, rows, out, waiting, str(n), clean, limits, settle, attempts)

    writer = files(spark, inbox, glob, archive).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def settle_waiting(spark: SparkSession, out: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] | None = None, limits: Limits = Limits(), settle: float = 0.0, attempts: int = 3) -> int:
    """Look at the files that wait, without new ones; how many wait then. Not while a stream of the same checkpoint runs."""
    waiting = Waiting(spark, f"{checkpoint}-waiting")
    k, before = waiting.turn("")
    if before is None or waiting.read(before).isEmpty():
        return 0
    return take(spark, None, out, waiting, f"again{k}", clean, limits, settle, attempts)


def events(stream: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts by window and key, with a watermark."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
