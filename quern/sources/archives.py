"""Text corpora as sources: directories, zip archives, saved HTML and small configuration lists."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import first_line, normalise_bytes, trim
from quern.operators.chunking import knowledge_chunks, long_pieces, visible_text
from quern.operators.ingest import BATCH_ROW, batch


#: Bytes of members after which a frame of them is handed on.
FRAME_BYTES = 8_000_000


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path (relative) and content (binary) of every *.txt below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    root = path.rstrip("/").rpartition("/")[2]
    return files.select(F.substring_index(F.col("path"), f"/{root}/", -1).alias("path"), "content")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """source (file name) and text of a folder's Markdown files; a folder without any is an error."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path)
    out = files.select(F.substring_index("_metadata.file_path", "/", -1).alias("source"), F.col("value").alias("text")).orderBy("source")
    if out.isEmpty():
        raise ValueError(f"no Markdown files in {path}")
    return out


def knowledge_corpus(spark: SparkSession, path: str, most: int = 1200) -> DataFrame:
    """The chunks of a folder's Markdown files; files that give none at all are an error."""
    chunks = knowledge_chunks(markdown_files(spark, path), most)
    if chunks.isEmpty():
        raise ValueError(f"no chunks in the Markdown files of {path}")
    return chunks


def check_archive(name: str) -> None:
    """Refuse files that a download hasn't finished."""
    if name.endswith(".partial") or ".range" in name.rpartition("/")[2]:
        raise ValueError(f"{name} is an unfinished download")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every *.txt member of the archives, in the order of their names; a member with a bad checksum fails
    the read. An archive is one task's work, since its directory is at its end; its members leave in frames of some MB."""
    check_archive(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    held, size = [], 0
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        if not info.is_dir() and info.filename.endswith(".txt"):
                            held.append((info.filename, z.read(info)))
                            size += info.file_size
                        if size > FRAME_BYTES:
                            yield pd.DataFrame(held, columns=["path", "content"])
                            held, size = [], 0
                    yield pd.DataFrame(held, columns=["path", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "path string, content binary")


def bad_members(spark: SparkSession, path: str) -> DataFrame:
    """archive and member of every member of the archives whose checksum is wrong; an archive that can't be opened has a row with
    a null member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                bad: list[str | None] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for info in z.infolist():
                            try:
                                z.read(info)
                            except (zipfile.BadZipFile, OSError, ValueError, zlib.error):
                                bad.append(info.filename)
                except zipfile.BadZipFile:
                    bad.append(None)
                yield pd.DataFrame({"archive": [name] * len(bad), "member": bad}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string")


def json_batch(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The documents of JSON files that hold one object with a list `documents` each, through the batch guard."""
    body = spark.read.schema(f"documents array<{BATCH_ROW}>").json(path, multiLine=True)
    rows = body.select(F.explode("documents").alias("d")).select("d.*")
    return batch(rows, most) if most is not None else batch(rows)


def pages_as_documents(spark: SparkSession, path: str, most: int = 1200) -> DataFrame:
    """path, part and content of a folder's HTML and plain-text files: what they show, in pieces by the length splitter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.substring_index("path", ".", -1))
    text = F.decode("content", "UTF-8")
    shown = files.filter(kind.isin("html", "htm", "txt", "md")).select("path", F.when(kind.isin("html", "htm"), visible_text(text)).otherwise(text).alias("text"))
    return long_pieces(shown, "path", "text", most)


def write_predictions(rows: DataFrame, folder: str, key: str = "question_id") -> DataFrame:
    """Write predictions as JSON lines, one object a row with all its fields, and return them as read back. A row without a key
    can't be joined to its question: it is an error before anything is written."""
    if not rows.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"predictions without {key}")
    rows.write.json(folder, ignoreNullFields=False)
    return rows.sparkSession.read.schema(rows.schema).json(folder)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def derived(members: DataFrame) -> DataFrame:
    """source_type from the first folder, external_id from the file's name, title from the first line; empty texts go."""
    content = members.schema["content"].dataType.simpleString()
    text = normalise_bytes(F.col("content")) if content == "binary" else F.col("content")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.txt$", "")
    named = F.regexp_extract(stem, r"^(dsid_[^_]+)", 1)
    out = members.withColumn("content", text).filter(trim(F.col("content")) != "")
    return out.select(
        *(c for c in members.columns if c not in ("path", "content")),
        F.replace(F.lower(F.substring_index("path", "/", 1)), F.lit("-"), F.lit("_")).alias("source_type"),
        F.when(named != "", named).otherwise(stem).alias("external_id"),
        first_line(F.col("content")).alias("title"),
        "content",
    )


def recommendations(rows: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """Questions that aren't blank, each once, the first `most`; fewer than `least` is an error."""
    named = rows.select("ordinal", trim(F.col("question")).alias("question"), trim(F.col("category")).alias("category")).filter("question != ''")
    first = named.groupBy("question").agg(F.min("ordinal").alias("ordinal"), F.min_by("category", "ordinal").alias("category"))
    out = first.orderBy("ordinal").limit(most)
    if out.count() < least:
        raise ValueError(f"fewer than {least} recommendations")
    return out.select("question", "category")
