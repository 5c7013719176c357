"""Resumable ingestion: a file stream merged into a versioned document table, each document effectively once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import ingest


class VersionedTable:
    """Whole versions of a table in folders of their own, and a pointer to the current one that a rename switches."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        return p, p.getFileSystem(self.conf)

    def version(self) -> int | None:
        """The newest committed version: a marker is renamed into place once its table is whole."""
        p, fs = self._path("versions")
        if not fs.exists(p):
            return None
        found = [int(s.getPath().getName()) for s in fs.listStatus(p) if not s.getPath().getName().startswith("_")]
        return max(found, default=None)

    def read(self, schema: str) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], schema) if v is None else self.spark.read.schema(schema).parquet(f"{self.uri}/v{v}")

    def commit(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.uri}/v{version}")
        p, fs = self._path(f"versions/_{version}")
        fs.create(p, True).close()
        fs.rename(p, self._path(f"versions/{version}")[0])


SCHEMA = "corpus_id string, source string, external_id string, document_id string, content_hash string, index_fingerprint string, version int, deleted boolean"


def ingest_stream(files: DataFrame, table: VersionedTable, checkpoint: str, fingerprint: str, corpus_id: str = "corpus-a") -> None:
    """Take in all files that are there: source, external_id and content rows. Running it again adds nothing.

    A batch that was merged before a failure is known by its number; a document by its key and hash. Unchanged documents
    are left out before anything is computed for them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        done = table.version()
        if done is not None and number <= done:
            return
        old = table.read(SCHEMA)
        rows = batch.select(F.lit(corpus_id).alias("corpus_id"), "source", "external_id", F.sha2("content", 256).alias("content_hash"), F.lit(fingerprint).alias("index_fingerprint"))
        rows = ingest.latest_first(rows.withColumn("document_id", F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat_ws(":", *ingest.KEY), 256), 1, 48))), "content_hash")
        changed = ingest.detect_changes(rows, old).filter(F.col("status") != ingest.SAME)
        table.commit(ingest.upserted(old, changed), number)

    q = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by tumbling window and type with a watermark; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
