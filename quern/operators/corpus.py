"""Corpus generations: states, activation, rollback, statistics and the integrity gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ["STAGING", "EMBEDDING", "INDEXING", "VALIDATING", "READY", "ACTIVE", "FAILED", "RETIRED"]


def create(corpora: DataFrame, corpus_id: str, now: int) -> DataFrame:
    fresh = corpora.sparkSession.createDataFrame([(corpus_id, "STAGING", now, None)], corpora.schema)
    return corpora.unionByName(fresh)


def _move(corpora: DataFrame, corpus_id: str, allowed: list[str], now: int) -> DataFrame:
    found = [r["state"] for r in corpora.filter(F.col("corpus_id") == corpus_id).select("state").limit(2).collect()]
    if len(found) != 1 or found[0] not in allowed:
        raise ValueError(f"{corpus_id} can't be activated from {found or 'nothing'}")
    target = F.col("corpus_id") == corpus_id
    state = F.when(target, "ACTIVE").when(F.col("state") == "ACTIVE", "RETIRED").otherwise(F.col("state"))
    return corpora.withColumn("activated", F.when(target, F.lit(now)).otherwise(F.col("activated"))).withColumn("state", state)


def activate(corpora: DataFrame, corpus_id: str, now: int) -> DataFrame:
    """The control table with this corpus active and the one before it retired; nothing changes on an error."""
    return _move(corpora, corpus_id, ["READY", "VALIDATING", "ACTIVE"], now)


def rollback(corpora: DataFrame, corpus_id: str, now: int) -> DataFrame:
    return _move(corpora, corpus_id, ["RETIRED", "READY", "ACTIVE"], now)


def set_state(corpora: DataFrame, corpus_id: str, state: str) -> DataFrame:
    if state not in STATES:
        raise ValueError(f"no such state: {state}")
    return corpora.withColumn("state", F.when(F.col("corpus_id") == corpus_id, state).otherwise(F.col("state")))


def current(corpora: DataFrame) -> DataFrame:
    """The corpus to show: an active one first, then the last activated, then the last created."""
    return corpora.orderBy(F.when(F.col("state") == "ACTIVE", 0).otherwise(1), F.col("activated").desc_nulls_last(), F.col("created").desc(), "corpus_id").limit(1)


def statistics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts by corpus: live documents, chunks, embedded chunks, and a status."""
    d = docs.filter(~F.col("deleted")).groupBy("corpus_id").agg(F.count("*").alias("documents"))
    c = chunks.groupBy("corpus_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    out = d.join(c, "corpus_id", "full_outer").na.fill(0, ["documents", "chunks", "embedded"])
    status = F.when(F.col("documents") == 0, "EMPTY").when((F.col("chunks") > 0) & (F.col("embedded") == F.col("chunks")), "READY").otherwise("INGESTING")
    return out.withColumn("status", status).withColumn("backend", F.when(F.col("embedded") > 0, "VECTOR").otherwise("FTS_ONLY"))


def integrity(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: orphan chunks, documents without chunks, repeated chunk places, chunks without vectors."""
    d = docs.filter(~F.col("deleted")).select("corpus_id", "document_id")
    parts = [
        chunks.join(d, ["corpus_id", "document_id"], "left_anti").agg(F.count("*").alias("orphans")),
        d.join(chunks, ["corpus_id", "document_id"], "left_anti").agg(F.count("*").alias("unchunked")),
        chunks.groupBy("document_id", "chunk_index").count().filter("count > 1").agg(F.count("*").alias("repeated")),
        chunks.agg((F.count("*") - F.count("embedding")).alias("unembedded")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


# ---------------------------------------------------------------- freshness


def stale(expires: Column, as_of: str) -> Column:
    """Blank never expires, what isn't a date has expired, else the day after expiry."""
    blank = F.trim(F.coalesce(expires, F.lit(""))) == ""
    return F.when(blank, False).otherwise(F.coalesce(F.lit(as_of).cast("date") > F.try_to_date(expires, "yyyy-MM-dd"), F.lit(True)))


# What a note says of a snapshot that has expired, and of one that hasn't.
EXPIRED_NOTE = ("快照日期 ", "，已于 ", " 过期；不得作为当前事实，实时问题必须调用工具或明确说明无法核验。")
VALID_NOTE = ("快照日期 ", "，有效期至 ", "。")


def freshness_note(snapshot: Column, expires: Column, as_of: str) -> Column:
    """A snapshot's note: empty where neither date is known, else whether it has expired."""
    s, e = (F.trim(F.coalesce(c, F.lit(""))) for c in (snapshot, expires))
    note = lambda x: F.concat(F.lit(x[0]), s, F.lit(x[1]), e, F.lit(x[2]))
    return F.when((s == "") & (e == ""), "").when(stale(e, as_of), note(EXPIRED_NOTE)).otherwise(note(VALID_NOTE))
