"""Incremental ingest of uploaded files: each batch replaces the chunks of the files that it brings.

Uploads lie anywhere below an inbox; a file's name says which document it is. The store has two tables,
each with a partition for a batch: chunks, and a row for each upload that says what became of it (stored,
failed with an error, or superseded by a later upload of the same name in the same batch). The second one
is written last. A document's chunks are those of the last batch that stored it, so nothing is changed in
place, and a batch that is run again overwrites its own partitions. A failed upload leaves what there was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from murmura.functions.sensitivity import profile
from murmura.operators.chunking import semantic
from murmura.session import materialize, scratch, ship
from murmura.sources import files

CHUNKS = "filename string, chunk_id int, content string, raw_sensitivity_score double, privacy_epsilon double, dynamic_delta double"
FILES = "filename string, path string, status string, error string, chunks long"
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def chunks_of(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    scored = semantic(docs, size, overlap, "filename", "content").withColumn("p", profile(F.col("content")))
    return scored.select("filename", "chunk_id", "content", F.col("p.raw_score").alias("raw_sensitivity_score"), F.col("p.epsilon").alias("privacy_epsilon"), F.col("p.delta").alias("dynamic_delta"))


def store_batch(uploads: DataFrame, store: str, batch_id: int, size: int = 1000, overlap: int = 200) -> int:
    """Write the partitions of a batch of uploads (path, modificationTime, content); the number of files stored."""
    spark = uploads.sparkSession
    with scratch(spark):
        named = uploads.withColumn("filename", files.file_name(F.col("path")))
        read = materialize(files.parsed(named, lenient=False).select("filename", "path", "modificationTime", "content", "error"), "uploads")
        last = read.where("error IS NULL").groupBy("filename").agg(F.max(F.struct("modificationTime", "path")).alias("last"))
        told = read.drop("content").join(last, "filename", "left")
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("path") == F.col("last.path"), "stored").otherwise("superseded")
        told = materialize(told.select("filename", "path", status.alias("status"), "error"), "told")
        kept = read.join(told.where("status = 'stored'").select("path"), "path", "left_semi")
        chunks = materialize(chunks_of(kept.select("filename", "content"), size, overlap), "chunks")
        chunks.write.mode("overwrite").parquet(f"{store}/chunks/batch_id={batch_id}")
        sizes = chunks.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
        rows = told.join(sizes, "filename", "left").withColumn("chunks", F.when(F.col("status") == "stored", F.coalesce("n", F.lit(0))).otherwise(0).cast("long"))
        seen = files.write_counted(rows.drop("n"), lambda x: x.write.mode("overwrite").parquet(f"{store}/files/batch_id={batch_id}"), stored=F.count_if(F.col("status") == "stored"))
    return seen["stored"]


def start(
    spark: SparkSession, inbox: str, store: str, checkpoint: str, size: int = 1000, overlap: int = 200, files_per_batch: int = 1000, rebuild: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Store what is in the inbox and hasn't been seen; rebuild(chunks, batch_id) is called after each batch that stored a file."""
    ship(spark)

    def run(batch: DataFrame, batch_id: int) -> None:
        if store_batch(batch, store, batch_id, size, overlap) and rebuild is not None:
            rebuild(current(spark, store), batch_id)

    found = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(inbox)
    return found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, store: str) -> DataFrame:
    """What became of each upload: FILES and its batch_id."""
    schema = f"{FILES}, batch_id long"
    return spark.read.schema(schema).parquet(f"{store}/files") if files.exists(spark, f"{store}/files") else spark.createDataFrame([], schema)


def _owners(spark: SparkSession, store: str) -> DataFrame:
    """(filename, batch_id): the batch whose chunks are a document's."""
    return results(spark, store).where("status = 'stored'").groupBy("filename").agg(F.max("batch_id").alias("batch_id"))


def current(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of all documents (CHUNKS)."""
    if not files.exists(spark, f"{store}/chunks"):
        return spark.createDataFrame([], CHUNKS)
    rows = spark.read.schema(f"{CHUNKS}, batch_id long").parquet(f"{store}/chunks")
    return rows.join(_owners(spark, store), ["filename", "batch_id"], "left_semi").drop("batch_id")


def vacuum(spark: SparkSession, store: str) -> list[int]:
    """Delete the chunks of batches that hold no document's current ones; the batches' numbers. Not while a reader is at work."""
    if not files.exists(spark, f"{store}/chunks"):
        return []
    live = {r.batch_id for r in _owners(spark, store).select("batch_id").distinct().collect()}
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/chunks")
    fs, gone = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for found in fs.listStatus(top):
        name = found.getPath().getName()
        if name.startswith("batch_id=") and (number := int(name.removeprefix("batch_id="))) not in live:
            fs.delete(found.getPath(), True)
            gone.append(number)
    return sorted(gone)
