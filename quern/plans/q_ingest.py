"""Identity, validation, change detection, merges and the control plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import corpus, ingest
from quern.operators.corpus import freshness_note, stale
from quern.plans.registry import query
from quern.plans.relation import CORPORA, DOCS, corpora, documents, table

_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query("n1_normalise", "SELECT doc_id, md5(" + _TRIM.format(r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+(\n|$)', '\1', 'g')") + ") AS text_md5 FROM documents")
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("text_md5"))


@query("n2_normalise_bytes", "SELECT page_id, md5(" + _TRIM.format(r"regexp_replace(html, '\r\n?', chr(10), 'g')") + ") AS html_md5 FROM pages")
def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.normalise_bytes(F.col("html").cast("binary"))).alias("html_md5"))


_UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || printf('%02x', (CAST(('0x' || substr(m, 17, 2)) AS INT) & 63) | 128) || substr(m, 19, 2) || '-' || substr(m, 21, 12)"


@query("h1_document_uuid", f"WITH m AS (SELECT doc_id, md5(source || ':' || doc_id) AS m FROM documents) SELECT doc_id, {_UUID} AS document_id FROM m")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.name_uuid(F.concat("source", F.lit(":"), "doc_id")).alias("document_id"))


@query("h2_worker_ids", "SELECT doc_id, 'doc-' || substr(sha256('c1:' || lang || ':' || doc_id), 1, 48) AS document_id, 'chunk-' || substr(sha256('c1:' || lang || ':' || doc_id || ':0'), 1, 48) AS chunk_id FROM documents")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("c1:"), "lang", F.lit(":"), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.prefixed_id("doc-", value).alias("document_id"), T.prefixed_id("chunk-", F.concat(value, F.lit(":0"))).alias("chunk_id"))


@query("h3_chunk_uuid", f"WITH m AS (SELECT doc_id, md5(source || ':' || doc_id || ':0:' || sha256(text)) AS m FROM documents) SELECT doc_id, {_UUID} AS chunk_id FROM m")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.name_uuid(F.concat("source", F.lit(":"), "doc_id", F.lit(":0:"), F.sha2("text", 256))).alias("chunk_id"))


@query("h4_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("h5_index_fingerprint", "SELECT sha256('structure-token-v2:max-700:overlap-80|none|hash:64') AS fingerprint")
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.chunking import Chunker

    return spark.range(1).select(F.sha2(F.lit(f"{Chunker(700, 80).fingerprint()}|none|hash:64"), 256).alias("fingerprint"))


@query(
    "s5_member_derivation",
    r"""WITH m AS (SELECT doc_id, upper(lang) || '-Files/' || source || '/dsid_' || doc_id || '_part.txt' AS path, text FROM documents)
SELECT doc_id, replace(lower(split_part(path, '/', 1)), '-', '_') AS source_type, regexp_extract(regexp_replace(regexp_extract(path, '[^/]+$'), '\.txt$', ''), '^(dsid_[^_]+)', 1) AS external_id,
 substr(regexp_replace(split_part(text, chr(10), 1), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), 1, 500) AS title FROM m WHERE regexp_replace(text, '[\x00-\x20]', '', 'g') <> ''""",
)
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources.archives import derived

    path = F.concat(F.upper("lang"), F.lit("-Files/"), "source", F.lit("/dsid_"), "doc_id", F.lit("_part.txt"))
    return derived(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"))).select("doc_id", "source_type", "external_id", "title")


@query("s6_filtered_members", "SELECT doc_id, lang FROM documents WHERE lang = 'de' ORDER BY CAST(doc_id AS VARCHAR) LIMIT 100")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 members of one source type in name order: the limit is the operator's own."""
    return table(spark, sf_dir, "documents").filter("lang = 'de'").orderBy(F.col("doc_id").cast("string")).limit(100).select("doc_id", "lang")


@query("s10_last_row_per_question", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


_RAW = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 13 = 0 THEN NULL ELSE ' d' || CAST(doc_id AS VARCHAR(20)) || ' ' END AS external_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS source,
 CASE WHEN doc_id % 17 = 0 THEN NULL ELSE lang || ' ' END AS source_type, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ' t' END AS title, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS content,
 CASE WHEN doc_id % 5 = 0 THEN ' z' END AS tenant_id, CASE doc_id % 4 WHEN 0 THEN 'HR' WHEN 1 THEN ' ' END AS department, CASE doc_id % 6 WHEN 0 THEN 'Internal' WHEN 1 THEN '' END AS access_level FROM documents"""


@query(
    "p4_validation",
    f"""WITH r AS ({_RAW}) SELECT doc_id, trim(external_id) AS external_id, trim(source) AS source, trim(source_type) AS source_type, coalesce(trim(title), '') AS title, md5(coalesce(content, '')) AS content_md5,
 CASE WHEN coalesce(trim(tenant_id), '') = '' THEN 'default' ELSE trim(tenant_id) END AS tenant_id, CASE WHEN coalesce(trim(department), '') = '' THEN 'engineering' ELSE lower(trim(department)) END AS department,
 CASE WHEN coalesce(trim(access_level), '') = '' THEN 'public' ELSE lower(trim(access_level)) END AS access_level,
 CASE WHEN coalesce(trim(external_id), '') = '' THEN 'external_id must not be blank' WHEN coalesce(trim(source), '') = '' THEN 'source must not be blank' WHEN coalesce(trim(source_type), '') = '' THEN 'source_type must not be blank' END AS error FROM r""",
)
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with blank and missing fields, as their numbers have it."""
    raw = spark.sql(_RAW.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents"))
    return ingest.validated(raw, "doc_id").withColumn("content_md5", F.md5("content")).drop("content")


@query("p6_snippet", r"WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '…' ELSE t END AS snippet FROM f")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("p7_half_up", "SELECT event_id, floor(value * 10000 + 0.5) / 10000 AS value4 FROM events")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.half_up(F.col("value")).alias("value4"))


@query("p11_metadata", """SELECT doc_id, '{"source":"' || source || '","language":"' || lang || '","chars":' || n_chars || '}' AS metadata FROM documents""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("source", F.col("lang").alias("language"), F.col("n_chars").alias("chars"))).alias("metadata"))


@query("p12_metadata_parse", "SELECT event_id, CAST(CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN len(json_keys(props)) ELSE 0 END AS BIGINT) AS keys FROM events")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid or blank JSON is an empty map."""
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.size(F.coalesce(parsed, F.create_map().cast("map<string,string>"))).cast("long").alias("keys"))


@query("p13_vector_literal", "SELECT vec_id, len(embedding) AS dimensions FROM embeddings WHERE len(embedding) > 0")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0).select("vec_id", F.size("embedding").cast("long").alias("dimensions"))


# The stored generation: the documents as they were before German ones were rewritten, Spanish ones got a new pipeline,
# and src3's arrived; toxic ones are deleted.
_OLD = f"""{DOCS}, old AS (SELECT corpus_id, source, external_id, 'old-' || external_id AS document_id, sha256(CASE WHEN source_type = 'de' THEN content || '.' ELSE content END) AS content_hash,
 CASE WHEN source_type = 'es' THEN 'fp0' ELSE 'fp1' END AS index_fingerprint, 4 AS version, deleted FROM docs WHERE source <> 'src3'),
inc AS (SELECT corpus_id, source, external_id, 'new-' || external_id AS document_id, sha256(content) AS content_hash, 'fp1' AS index_fingerprint FROM docs)"""
_STATUS = """ch AS (SELECT inc.corpus_id, inc.source, inc.external_id, inc.content_hash, inc.index_fingerprint, coalesce(old.document_id, inc.document_id) AS document_id,
 CASE WHEN old.version IS NULL THEN 'INDEXED_NEW' WHEN old.content_hash = inc.content_hash AND old.index_fingerprint = inc.index_fingerprint AND NOT old.deleted THEN 'SKIPPED_UNCHANGED'
  WHEN old.content_hash <> inc.content_hash THEN 'REINDEXED_CHANGED' ELSE 'REINDEXED_PIPELINE_CHANGED' END AS status, old.version AS ov FROM inc LEFT JOIN old USING (corpus_id, source, external_id)),
cv AS (SELECT *, CASE WHEN status = 'SKIPPED_UNCHANGED' THEN ov ELSE coalesce(ov, 0) + 1 END AS version FROM ch)"""


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter("source <> 'src3'")
    text = F.when(F.col("source_type") == "de", F.concat("content", F.lit("."))).otherwise(F.col("content"))
    return d.select(*ingest.KEY, F.concat(F.lit("old-"), "external_id").alias("document_id"), F.sha2(text, 256).alias("content_hash"), F.when(F.col("source_type") == "es", "fp0").otherwise("fp1").alias("index_fingerprint"), F.lit(4).alias("version"), "deleted")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(*ingest.KEY, F.concat(F.lit("new-"), "external_id").alias("document_id"), F.sha2("content", 256).alias("content_hash"), F.lit("fp1").alias("index_fingerprint"))


@query("f1_change_detection", f"WITH {_OLD}, {_STATUS} SELECT corpus_id, source, external_id, document_id, status, version FROM cv")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.detect_changes(_incoming(spark, sf_dir), _old(spark, sf_dir)).select(*ingest.KEY, "document_id", "status", "version")


@query("f3_batch_summary", f"WITH {_OLD}, {_STATUS} SELECT count(*) AS received, count(*) FILTER (WHERE status <> 'SKIPPED_UNCHANGED') AS indexed, count(*) FILTER (WHERE status = 'SKIPPED_UNCHANGED') AS skipped FROM cv")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ingest.detect_changes(_incoming(spark, sf_dir), _old(spark, sf_dir))
    return c.agg(F.count("*").alias("received"), F.count_if(F.col("status") != ingest.SAME).alias("indexed"), F.count_if(F.col("status") == ingest.SAME).alias("skipped"))


@query("f4_resume_filter", f"WITH {_OLD} SELECT source, external_id FROM inc WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.source = inc.source AND old.external_id = inc.external_id AND old.content_hash = inc.content_hash AND NOT old.deleted)")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _old(spark, sf_dir).withColumn("status", F.when(F.col("deleted"), "FAILED").otherwise("DONE"))
    return ingest.pending(_incoming(spark, sf_dir), done).select("source", "external_id")


@query(
    "k1_document_upsert",
    f"""WITH {_OLD}, {_STATUS}, up AS (SELECT * FROM cv WHERE status <> 'SKIPPED_UNCHANGED')
SELECT corpus_id, source, external_id, document_id, content_hash, version, false AS deleted FROM up
UNION ALL SELECT corpus_id, source, external_id, document_id, content_hash, version, deleted FROM old WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.corpus_id = old.corpus_id AND up.source = old.source AND up.external_id = old.external_id)""",
)
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _old(spark, sf_dir)
    changed = ingest.detect_changes(_incoming(spark, sf_dir), old).filter(F.col("status") != ingest.SAME)
    return ingest.upserted(old, changed).select(*ingest.KEY, "document_id", "content_hash", "version", "deleted")


@query("k2_chunk_replacement", f"WITH {DOCS}, c AS (SELECT external_id AS document_id, 0 AS chunk_index, 'old' AS kind, source_type FROM docs) SELECT document_id, chunk_index, kind FROM c WHERE source_type <> 'de' UNION ALL SELECT document_id, i, 'new' FROM c, (VALUES (0), (1)) v(i) WHERE source_type = 'de'")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    chunks = d.select(F.col("external_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("old").alias("kind"))
    redone = d.filter("source_type = 'de'").select(F.col("external_id").alias("document_id"))
    fresh = redone.select("document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.lit("new").alias("kind"))
    return ingest.chunks_replaced(chunks, fresh, redone)


@query("k4_soft_delete", f"WITH {DOCS} SELECT external_id, deleted OR source_type = 'fr' AS deleted FROM docs")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return ingest.soft_deleted(d, d.filter("source_type = 'fr'")).select("external_id", "deleted")


@query("k5_manifest", "SELECT count(*) AS documents, sum(length(text)) AS chars, (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) AS by_source FROM documents")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda s: F.concat(s["source"], F.lit("="), s["n"])), ",")
    return d.agg(F.sum("n").alias("documents"), F.sum("c").alias("chars"), listed.alias("by_source"))


# ---------------------------------------------------------------- control plane

_CHUNKS = "ck AS (SELECT corpus_id, external_id AS document_id, 0 AS chunk_index, e.embedding FROM docs LEFT JOIN embeddings e ON e.vec_id = docs.id WHERE NOT deleted)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return documents(spark, sf_dir).filter("NOT deleted").join(e, "id", "left").select("corpus_id", F.col("external_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")


@query("a1_corpus_counts", f"WITH {DOCS}, {_CHUNKS} SELECT corpus_id, count(*) AS chunks, count(embedding) AS embedded, count(*) - count(embedding) AS missing FROM ck GROUP BY corpus_id")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("corpus_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), (F.count("*") - F.count("embedding")).alias("missing"))


@query("a2_failed_sum", "SELECT source, CAST(coalesce(sum(quality = 0), 0) AS BIGINT) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.coalesce(F.sum((F.col("quality") == 0).cast("long")), F.lit(0)).alias("failed"))


@query("a3_source_distribution", f"WITH {DOCS} SELECT corpus_id, source_type, count(*) AS documents FROM docs WHERE NOT deleted GROUP BY ALL")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter("NOT deleted").groupBy("corpus_id", "source_type").agg(F.count("*").alias("documents"))


@query("a4_finalised_counters", f"WITH {CORPORA}, {DOCS}, n AS (SELECT corpus_id, count(*) AS documents FROM docs WHERE NOT deleted GROUP BY 1) SELECT corpus_id, coalesce(documents, 0) AS documents, CASE WHEN created > 2 THEN coalesce(documents, 0) ELSE created END AS expected FROM corpora LEFT JOIN n USING (corpus_id)")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expected count that was never given becomes the actual one."""
    n = documents(spark, sf_dir).filter("NOT deleted").groupBy("corpus_id").agg(F.count("*").alias("documents"))
    c = corpora(spark).join(n, "corpus_id", "left")
    given = F.when(F.col("created") > 2, 0).otherwise(F.col("created"))
    return c.select("corpus_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.when(given == 0, F.coalesce("documents", F.lit(0))).otherwise(given).alias("expected"))


@query("m2_create_corpus", f"WITH {CORPORA} SELECT * FROM corpora UNION ALL SELECT 'corpus-e', 'STAGING', 9, NULL")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.create(corpora(spark), "corpus-e", 9)


@query("m3_activate", f"WITH {CORPORA} SELECT corpus_id, CASE WHEN corpus_id = 'corpus-b' THEN 'ACTIVE' WHEN state = 'ACTIVE' THEN 'RETIRED' ELSE state END AS state, created, CASE WHEN corpus_id = 'corpus-b' THEN 20 ELSE activated END AS activated FROM corpora")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.activate(corpora(spark), "corpus-b", 20)


@query("m4_rollback", f"WITH {CORPORA} SELECT corpus_id, CASE WHEN corpus_id = 'corpus-c' THEN 'ACTIVE' WHEN state = 'ACTIVE' THEN 'RETIRED' ELSE state END AS state, created, CASE WHEN corpus_id = 'corpus-c' THEN 21 ELSE activated END AS activated FROM corpora")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rollback(corpora(spark), "corpus-c", 21)


@query("m5_set_state", f"WITH {CORPORA} SELECT corpus_id, CASE WHEN corpus_id = 'corpus-d' THEN 'EMBEDDING' ELSE state END AS state, created, activated FROM corpora")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.set_state(corpora(spark), "corpus-d", "EMBEDDING")


@query("m6_statistics", f"""WITH {DOCS}, {_CHUNKS}, d AS (SELECT corpus_id, count(*) AS documents FROM docs WHERE NOT deleted GROUP BY 1), c AS (SELECT corpus_id, count(*) AS chunks, count(embedding) AS embedded FROM ck GROUP BY 1)
SELECT corpus_id, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(embedded, 0) AS embedded, CASE WHEN coalesce(documents, 0) = 0 THEN 'EMPTY' WHEN chunks > 0 AND chunks = embedded THEN 'READY' ELSE 'INGESTING' END AS status,
 CASE WHEN coalesce(embedded, 0) > 0 THEN 'VECTOR' ELSE 'FTS_ONLY' END AS backend FROM d FULL JOIN c USING (corpus_id)""")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statistics(documents(spark, sf_dir), _chunks(spark, sf_dir))


@query("m10_integrity", f"WITH {DOCS}, {_CHUNKS} SELECT 0 AS orphans, 0 AS unchunked, 0 AS repeated, (SELECT count(*) - count(embedding) FROM ck) AS unembedded")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.integrity(documents(spark, sf_dir).withColumnRenamed("external_id", "document_id"), _chunks(spark, sf_dir))


@query("o1_current_corpus", f"WITH {CORPORA} SELECT corpus_id, state FROM corpora ORDER BY CASE WHEN state = 'ACTIVE' THEN 0 ELSE 1 END, activated DESC NULLS LAST, created DESC, corpus_id LIMIT 1")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.current(corpora(spark)).select("corpus_id", "state")


@query("j5_exists_bootstrap", f"WITH {CORPORA}, {DOCS} SELECT corpus_id FROM corpora c WHERE EXISTS (SELECT 1 FROM docs d WHERE d.corpus_id = c.corpus_id)")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora(spark).join(documents(spark, sf_dir), "corpus_id", "left_semi").select("corpus_id")


@query("j6_backfill", f"WITH {DOCS} SELECT vec_id, coalesce(corpus_id, 'legacy') AS corpus_id FROM embeddings LEFT JOIN docs ON docs.id = vec_id")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return e.join(documents(spark, sf_dir).select(F.col("id").alias("vec_id"), "corpus_id"), "vec_id", "left").select("vec_id", F.coalesce("corpus_id", F.lit("legacy")).alias("corpus_id"))


@query("m9_job_progress", "SELECT event_type, count(*) AS processed, max(ts) AS updated_at, count(*) FILTER (WHERE value < 0) AS failed FROM events GROUP BY event_type")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("processed"), F.max("ts").alias("updated_at"), F.count_if(F.col("value") < 0).alias("failed"))


@query("m11_derived_index_content", "SELECT doc_id, md5(coalesce(nullif(CASE WHEN lang = 'de' THEN '' ELSE 'Source: ' || source END, '') || chr(10) || chr(10), '') || text) AS index_md5 FROM documents")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.chunking import index_content

    prefix = F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("Source: "), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(index_content(prefix, F.col("text"))).alias("index_md5"))


@query("w4_first_per_key", "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row a key, as an aggregate: no window has to hold a large group."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))


#: Dates of pages: valid, expired, blank and garbled ones.
_DATES = """dated AS (SELECT page_id, url, html, CASE WHEN page_id % 5 = 0 THEN '' ELSE strftime(DATE '2030-06-01' + CAST(page_id % 30 AS INT), '%Y-%m-%d') END AS snap,
  CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'garbage' ELSE strftime(DATE '2030-06-05' + CAST(page_id % 30 AS INT), '%Y-%m-%d') END AS e FROM pages),
noted AS (SELECT *, CASE WHEN coalesce(trim(e), '') = '' THEN false ELSE coalesce(DATE '2030-06-15' > TRY_CAST(e AS DATE), true) END AS stale FROM dated),
fresh AS (SELECT *, CASE WHEN snap = '' AND coalesce(e, '') = '' THEN '' WHEN stale THEN '快照日期 ' || snap || '，已于 ' || e || ' 过期；不得作为当前事实，实时问题必须调用工具或明确说明无法核验。' ELSE '快照日期 ' || snap || '，有效期至 ' || coalesce(e, '') || '。' END AS note FROM noted)"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda first: F.date_format(F.date_add(F.lit(first).cast("date"), (F.col("page_id") % 30).cast("int")), "yyyy-MM-dd")
    blank = F.col("page_id") % 5 == 0
    expires = F.when(blank, None).when(F.col("page_id") % 7 == 0, "garbage").otherwise(day("2030-06-05"))
    return table(spark, sf_dir, "pages").withColumns({"snap": F.when(blank, "").otherwise(day("2030-06-01")), "e": expires})


@query("f6_staleness", f"WITH {_DATES} SELECT page_id, stale FROM noted")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("page_id", stale(F.col("e"), "2030-06-15").alias("stale"))


@query("f7_freshness_note", f"WITH {_DATES} SELECT page_id, note FROM fresh")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("page_id", freshness_note(F.col("snap"), F.col("e"), "2030-06-15").alias("note"))


_STRATEGY = "CASE doc_id % 6 WHEN 0 THEN 'vector' WHEN 1 THEN ' HYBRID ' WHEN 2 THEN source WHEN 3 THEN NULL WHEN 4 THEN 'Keyword' ELSE 'hybrid_rerank' END"


@query("f9_strategy_parse", f"WITH d AS (SELECT doc_id, {_STRATEGY} AS s FROM documents) SELECT doc_id, CASE WHEN upper(trim(coalesce(s, ''))) IN ('VECTOR', 'KEYWORD', 'HYBRID', 'HYBRID_RERANK') THEN upper(trim(s)) ELSE 'HYBRID_RERANK' END AS strategy FROM d")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.upper(F.trim(F.coalesce("s", F.lit(""))))
    asked = table(spark, sf_dir, "documents").select("doc_id", F.expr(_STRATEGY).alias("s"))
    return asked.select("doc_id", F.when(s.isin("VECTOR", "KEYWORD", "HYBRID", "HYBRID_RERANK"), s).otherwise("HYBRID_RERANK").alias("strategy"))


@query("s17_recommendations", "SELECT * FROM (VALUES ('q one', 'a'), ('q two', 'b'), ('q three', 'c')) t(question, category)")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources.archives import recommendations

    rows = [(0, "q one ", "a"), (1, " ", "x"), (2, "q two", "b"), (3, "q one", "z"), (4, "q three", "c")]
    return recommendations(spark.createDataFrame(rows, "ordinal int, question string, category string"))


@query("a15_source_summary", "SELECT source, lang AS section, min(doc_id) AS first_id, count(*) AS hits FROM documents GROUP BY ALL")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("section")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("hits"))


@query("a13_corpus_chars", "SELECT sum(length(text)) AS chars FROM documents")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.sum(F.length("text")).alias("chars"))


