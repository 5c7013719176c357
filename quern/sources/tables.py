"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of
    its own; on a cluster that is an error, since other hosts wouldn't see such a folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(d)
        atexit.register(remove, spark, d)
    return d.rstrip("/")


def remove(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone: its cleaner or the next run's owner removes the folder
        return


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared one; removed when the driver ends."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, uri)
    return uri


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: it cuts the lineage and survives lost executors."""
    uri = new_folder(df.sparkSession, label)
    df.write.parquet(uri, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder or file in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:" + uri.removeprefix("file:"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row's content (binary) as the file `path` below the folder and return their number. Attempts of one task write
    the same bytes under the same names, each file whole under a name of its own and then moved."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                fs, name = filesystem(f"{folder}/{path}")
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                own = f"{name}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(own, compression=None) as out:
                    out.write(content)
                try:
                    fs.move(own, name)
                except OSError:
                    if fs.get_file_info(name).type.name != "File":
                        raise
                    fs.delete_file(own)
            yield batch.select(["path"])

    return rows.select("path", "content").mapInArrow(run, "path string").count()


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the rows' places from 1 in a total order, without a task that has all rows: the range-partitioned sort is
    written with each row's place in its partition, and a running sum over one row a partition says where each begins."""
    at = f"at_{uuid.uuid4().hex}"
    kept = written(df.sort(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("part").alias(f"part_{at}"), before.alias(f"start_{at}"))
    out = kept.join(starts, part == F.col(f"part_{at}"))
    return out.withColumn(name, (F.col(f"start_{at}") + within + 1).cast("int")).drop(at, f"part_{at}", f"start_{at}")
