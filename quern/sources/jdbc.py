"""Database tables as sources: a primary one, and a replica that is connected to on first use and answers in bounded time."""

from __future__ import annotations

import uuid
import zipfile
from contextlib import closing
from dataclasses import dataclass, field
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.tables import new_folder, remove

#: The database that Spark brings along, within a JVM.
EMBEDDED = "org.apache.derby.jdbc.EmbeddedDriver"


@dataclass
class Database:
    """Where and how to connect. Nothing is asked of the database before a table is read.

    Tasks hold a connection each, so `most_connections` bounds them; a statement ends after `timeout_s` seconds (0: never).
    """

    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    most_connections: int = 8
    timeout_s: int = 0
    fetch_rows: int = 10_000

    def __post_init__(self) -> None:
        if not self.url.startswith("jdbc:"):
            raise ValueError("a database's address begins with jdbc:")
        if self.most_connections < 1:
            raise ValueError("at least one connection is needed")

    def options(self) -> dict[str, str]:
        named = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver, "fetchsize": self.fetch_rows, "queryTimeout": self.timeout_s}
        return {k: str(v) for k, v in named.items() if v is not None}

    def table(self, spark: SparkSession, name: str, key: str | None = None) -> DataFrame:
        """A table, read in one part, or in ranges of a whole-number key by as many tasks as connections are allowed. Filters and
        columns go to the database. Rows without a key belong to the first range."""
        reader = spark.read.format("jdbc").options(**self.options()).option("dbtable", name)
        if key is None:
            return reader.load()
        low, high = reader.load().agg(F.min(key), F.max(key)).first()
        if low is None:
            return reader.load()
        parts = max(1, min(self.most_connections, high - low + 1))
        return reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)).load()

    def write(self, rows: DataFrame, name: str, mode: str = "errorifexists") -> None:
        """Write rows as a table, by no more tasks than connections are allowed."""
        rows.coalesce(self.most_connections).write.format("jdbc").options(**self.options()).option("dbtable", name).mode(mode).save()


def replica(database: Database, timeout_s: int = 3, most_connections: int = 4) -> Database:
    """The same database's replica for searches: its own few connections, and statements that end in time."""
    return Database(database.url, database.user, database.password, database.driver, most_connections, timeout_s, database.fetch_rows)


def in_memory(name: str = "quern") -> Database:
    """A database in the memory of one JVM: for a local session, whose tasks run in it."""
    return Database(f"jdbc:derby:memory:{name};create=true", driver=EMBEDDED)


def sealed(rows: DataFrame, name: str) -> Database:
    """A read-only database whose one table is `rows`, as a file that any number of JVMs read at once: for a cluster that has no
    database server. Tasks write the rows as text, the driver's JVM imports the files one by one and closes the database, which
    then goes into an uncompressed archive in the shared folder."""
    for c in rows.schema:
        if not isinstance(c.dataType, (T.IntegralType, T.FractionalType, T.StringType, T.BooleanType, T.DateType, T.BinaryType)):
            raise ValueError(f"{c.name}: {c.dataType.simpleString()} isn't taken by a sealed database")
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "database")
    if not folder.startswith(("file:", "/")):
        raise ValueError("spark.quern.jdbc.url must name a database: the shared folder isn't in a file system that databases open")
    home = Path("/" + folder.removeprefix("file:").lstrip("/"))
    # a field is quoted, and nothing at all if it is null
    text = (F.hex(c.name) if isinstance(c.dataType, T.BinaryType) else F.col(f"`{c.name}`").cast("string") for c in rows.schema)
    line = F.concat_ws(",", *(F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in text))
    rows.select(line.alias("value")).write.text(f"{folder}/rows")
    own = f"jdbc:derby:{home}/{uuid.uuid4().hex}"
    Database(f"{own};create=true", driver=EMBEDDED).write(spark.createDataFrame([], rows.schema), name)
    driver, properties = spark._jvm.org.apache.derby.jdbc.EmbeddedDriver(), spark._jvm.java.util.Properties()
    with closing(driver.connect(own, properties)) as c, closing(c.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, ?, ?, ',', '\"', 'UTF-8', 0)")) as call:
        for part in sorted((home / "rows").glob("part-*")):
            call.setString(1, name.upper())
            call.setString(2, str(part))
            call.execute()
    try:
        driver.connect(f"{own};shutdown=true", properties)
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # this is how a closed database answers
            raise
    files = Path(own.removeprefix("jdbc:derby:"))
    with zipfile.ZipFile(home / "database.jar", "w") as z:  # stored, so that pages are read where they are
        for f in sorted(files.rglob("*")):
            z.write(f, Path("db") / f.relative_to(files))
    remove(spark, f"{folder}/rows")
    remove(spark, f"file://{files}")
    return Database(f"jdbc:derby:jar:({home}/database.jar)db", driver=EMBEDDED)
