"""How the driver's tables stand in for a document corpus, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import first_line


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the columns of a versioned, access-controlled corpus: languages stand for departments and corpora,
    one source for another tenant, and toxic documents are deleted ones."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("deleted")).distinct()
    d = table(spark, sf_dir, "documents").join(gone, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang").isin("en", "fr"), "corpus-a").otherwise("corpus-b").alias("corpus_id"),
        F.col("doc_id").cast("string").alias("external_id"),
        "source",
        F.col("lang").alias("source_type"),
        first_line(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        F.when(F.col("source") == "src1", "tenant-b").otherwise("default").alias("tenant_id"),
        F.when(F.col("lang") == "fr", "finance").when(F.col("lang") == "de", "hr").otherwise("engineering").alias("department"),
        F.when(F.col("lang") == "en", "public").otherwise("internal").alias("access_level"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
    )


DOCS = r"""docs AS (SELECT d.doc_id AS id, CASE WHEN lang IN ('en', 'fr') THEN 'corpus-a' ELSE 'corpus-b' END AS corpus_id, CAST(d.doc_id AS VARCHAR) AS external_id,
  source, lang AS source_type, substr(regexp_replace(split_part(text, chr(10), 1), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), 1, 500) AS title, text AS content,
  CASE WHEN source = 'src1' THEN 'tenant-b' ELSE 'default' END AS tenant_id,
  CASE lang WHEN 'fr' THEN 'finance' WHEN 'de' THEN 'hr' ELSE 'engineering' END AS department,
  CASE WHEN lang = 'en' THEN 'public' ELSE 'internal' END AS access_level, coalesce(g.deleted, false) AS deleted
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, true AS deleted FROM labels WHERE toxic = 1) g ON g.doc_id = d.doc_id)"""


def corpora(spark: SparkSession) -> DataFrame:
    rows = [("corpus-a", "ACTIVE", 3, 10), ("corpus-b", "READY", 2, None), ("corpus-c", "RETIRED", 1, 5), ("corpus-d", "STAGING", 4, None)]
    return spark.createDataFrame(rows, "corpus_id string, state string, created int, activated int")


CORPORA = "corpora AS (SELECT * FROM (VALUES ('corpus-a', 'ACTIVE', 3, 10), ('corpus-b', 'READY', 2, NULL), ('corpus-c', 'RETIRED', 1, 5), ('corpus-d', 'STAGING', 4, NULL)) t(corpus_id, state, created, activated))"


def live(docs: DataFrame, control: DataFrame) -> DataFrame:
    """Documents that aren't deleted, of the one active corpus."""
    active = control.filter("state = 'ACTIVE'").orderBy("corpus_id").limit(1).select("corpus_id")
    return docs.filter(~F.col("deleted")).join(F.broadcast(active), "corpus_id", "left_semi")


LIVE = "live AS (SELECT * FROM docs WHERE NOT deleted AND corpus_id = (SELECT corpus_id FROM corpora WHERE state = 'ACTIVE' ORDER BY corpus_id LIMIT 1))"
