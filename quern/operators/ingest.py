"""Ingestion: validation, identity, change detection and the merges that replace upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import blank_to, trim

MOST_IN_BATCH = 1000
KEY = ["corpus_id", "source", "external_id"]
NEW, CHANGED, PIPELINE, SAME = "INDEXED_NEW", "REINDEXED_CHANGED", "REINDEXED_PIPELINE_CHANGED", "SKIPPED_UNCHANGED"


def validated(rows: DataFrame, *carried: str) -> DataFrame:
    """Defaults and trimming; `error` says what is missing, null where nothing is. Other columns go unless they are carried."""
    need = ["external_id", "source", "source_type"]
    blank = [F.when(trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"{c} must not be blank")) for c in need]
    return rows.select(
        *carried,
        *(trim(F.col(c)).alias(c) for c in need),
        trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        blank_to(F.col("tenant_id"), "default").alias("tenant_id"),
        F.lower(blank_to(F.col("department"), "engineering")).alias("department"),
        F.lower(blank_to(F.col("access_level"), "public")).alias("access_level"),
        F.coalesce(*blank).alias("error"),
    )


def status(old_hash: Column, old_print: Column, old_deleted: Column, new_hash: Column, new_print: Column, known: Column) -> Column:
    """What happens to an incoming document. A deleted one that is otherwise the same is indexed again."""
    same = (old_hash == new_hash) & (old_print == new_print) & ~old_deleted
    return F.when(~known, NEW).when(same, SAME).when(old_hash != new_hash, CHANGED).otherwise(PIPELINE)


def detect_changes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (key, document_id, content_hash, index_fingerprint) with status, version and the id that it keeps."""
    old = existing.select(*KEY, *(F.col(c).alias(f"old_{c}") for c in ("document_id", "content_hash", "index_fingerprint", "version", "deleted")))
    j = incoming.join(old, KEY, "left")
    known = F.col("old_version").isNotNull()
    kind = status(F.col("old_content_hash"), F.col("old_index_fingerprint"), F.coalesce("old_deleted", F.lit(False)), F.col("content_hash"), F.col("index_fingerprint"), known)
    j = j.withColumn("status", kind)
    version = F.when(F.col("status") == SAME, F.col("old_version")).otherwise(F.coalesce("old_version", F.lit(0)) + 1)
    return j.withColumn("version", version).withColumn("document_id", F.coalesce("old_document_id", "document_id")).drop(*(c for c in j.columns if c.startswith("old_")))


def latest_first(incoming: DataFrame, order: str) -> DataFrame:
    """One row a key: the last one given."""
    w = Window.partitionBy(*KEY).orderBy(F.col(order).desc())
    return incoming.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upserted(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """The document table after an upsert: rows of `changed` replace those with their key and live again."""
    kept = existing.join(changed.select(*KEY), KEY, "left_anti")
    return kept.unionByName(changed.withColumn("deleted", F.lit(False)).select(existing.columns))


def chunks_replaced(chunks: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunk table after all chunks of `documents` (document_id) are replaced by `fresh`."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def soft_deleted(existing: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows named by `gone` (source, external_id) count as deleted, in whatever corpus they are."""
    marks = gone.select("source", "external_id", F.lit(True).alias("__gone")).distinct()
    return existing.join(marks, ["source", "external_id"], "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).select(existing.columns)


def pending(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that no DONE row of the checkpoint has with the same hash."""
    finished = done.filter("status = 'DONE'").select("source", "external_id", "content_hash")
    return docs.join(finished, ["source", "external_id", "content_hash"], "left_anti")


#: A document of a JSON batch.
BATCH_ROW = "struct<external_id:string,source:string,source_type:string,title:string,content:string,tenant_id:string,department:string,access_level:string>"


def batch(rows: DataFrame, most: int = MOST_IN_BATCH) -> DataFrame:
    """A validated batch; an empty one, one of more than `most` rows, or one with an invalid row is refused whole."""
    out = validated(rows)
    n, wrong = out.agg(F.count("*"), F.min("error")).first()
    if not 0 < n <= most or wrong is not None:
        raise ValueError(wrong or f"a batch has 1 to {most} documents, not {n}")
    return out.drop("error")


def pipeline_fingerprint(config: dict) -> str:
    """SHA-256 of the configuration as JSON with sorted keys: a checkpoint made under another one isn't resumed."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
