"""The remaining operators: joins and sets by themselves, the index table, smoke queries, health and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import engine, ingest
from quern.operators import retrieval as R
from quern.operators.index import LexicalIndex
from quern.plans.q_ingest import _OLD, _STATUS, _chunks, _incoming, _old
from quern.plans.q_retrieval import LISTS, SEEN, _bm25_sql, _lexical, _tok, _vector, lexical_index
from quern.plans.registry import query
from quern.plans.relation import CORPORA, DOCS, corpora, documents, table
from quern.sources.tables import new_folder


@query("j2_composite_join", f"WITH {DOCS}, ck AS (SELECT corpus_id, external_id AS document_id, unnest([0, 1]) AS chunk_index FROM docs) SELECT d.corpus_id, d.external_id AS document_id, chunk_index, title FROM ck JOIN docs d ON d.external_id = ck.document_id AND d.corpus_id = ck.corpus_id")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumnRenamed("external_id", "document_id")
    ck = d.select("corpus_id", "document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    return ck.join(d.select("corpus_id", "document_id", "title"), ["corpus_id", "document_id"])


@query("j3_one_row_query", f"WITH {DOCS}, q AS (SELECT 'the' AS word) SELECT id, word FROM docs, q WHERE contains(content, word)")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([("the",)], "word string")
    return documents(spark, sf_dir).crossJoin(F.broadcast(q)).filter(F.contains("content", "word")).select("id", "word")


@query("j4_active_corpus_subquery", f"WITH {DOCS}, {CORPORA} SELECT id FROM docs WHERE corpus_id = (SELECT corpus_id FROM corpora WHERE state = 'ACTIVE' LIMIT 1)")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = corpora(spark).filter("state = 'ACTIVE'").select("corpus_id").limit(1)
    return documents(spark, sf_dir).filter(F.col("corpus_id") == active.scalar()).select("id")


@query("j7_existing_lookup", f"WITH {_OLD} SELECT inc.source, inc.external_id, old.document_id, old.version FROM inc LEFT JOIN old USING (corpus_id, source, external_id)")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _old(spark, sf_dir).select(*ingest.KEY, "document_id", "version")
    return _incoming(spark, sf_dir).drop("document_id").join(old, ingest.KEY, "left").select("source", "external_id", "document_id", "version")


@query("j9_candidate_merge", f"WITH {LISTS} SELECT query_id, id, max(vs) AS vs, max(bs) AS bs FROM (SELECT query_id, id, score AS vs, 0.0::DOUBLE AS bs FROM v UNION ALL SELECT query_id, id, 0.0::DOUBLE, score FROM a WHERE score > 0) GROUP BY ALL")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    z = F.lit(0.0)
    both = v.select("query_id", "id", F.col("score").alias("vs"), z.alias("bs")).unionByName(a.filter("score > 0").select("query_id", "id", z.alias("vs"), F.col("score").alias("bs")))
    return both.groupBy("query_id", "id").agg(F.max("vs").alias("vs"), F.max("bs").alias("bs"))


@query("a5_manifest_counts", "SELECT lang, count(*) AS documents, sum(length(text)) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.countDistinct("source").alias("sources"))


@query("a6_rrf_scores", f"WITH {LISTS} SELECT query_id, id, floor(sum(1.0::DOUBLE / (60 + rank)) * 1e9 + 0.5) / 1e9 AS score FROM (SELECT query_id, id, rank FROM v UNION ALL SELECT query_id, id, rank FROM a) GROUP BY ALL")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    u = v.select("query_id", "id", "rank").unionByName(a.select("query_id", "id", "rank"))
    return u.groupBy("query_id", "id").agg(R.rounded(F.sum(F.lit(1.0) / (60 + F.col("rank"))), 9).alias("score"))


@query("a8_term_frequencies", f"SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({_tok('text')}) AS term FROM conversations) GROUP BY ALL")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions.text import tokens

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tokens(F.col("text"))).alias("term"))
    return c.groupBy("conv_id", "turn", "term").agg(F.count("*").alias("tf"))


@query("p5_threshold_filter", "SELECT e.vec_id, floor(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.embedding IS NOT NULL AND floor(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 >= 0.2")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 1").select(R.doubles(F.col("embedding")).alias("q"))
    scored = e.filter("embedding IS NOT NULL").crossJoin(F.broadcast(q)).withColumn("v", R.doubles(F.col("embedding")))
    return scored.select("vec_id", R.rounded(R.dot(F.col("v"), F.col("q")) / (R.norm(F.col("v")) * R.norm(F.col("q")))).alias("score")).filter("score >= 0.2")


@query("f2_versions", f"WITH {_OLD}, {_STATUS} SELECT status, version, count(*) AS documents FROM cv GROUP BY ALL")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.detect_changes(_incoming(spark, sf_dir), _old(spark, sf_dir)).groupBy("status", "version").agg(F.count("*").alias("documents"))


@query("k3_bulk_merge", f"WITH {_OLD}, {_STATUS} SELECT source_type, count(*) FILTER (WHERE status <> 'SKIPPED_UNCHANGED') AS written, count(*) AS seen FROM cv JOIN (SELECT external_id, source_type FROM docs) USING (external_id) GROUP BY source_type")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ingest.detect_changes(_incoming(spark, sf_dir), _old(spark, sf_dir))
    types = documents(spark, sf_dir).select("external_id", "source_type")
    return c.join(types, "external_id").groupBy("source_type").agg(F.count_if(F.col("status") != ingest.SAME).alias("written"), F.count("*").alias("seen"))


@query("r4_posting_index", f"WITH {SEEN}, l AS (SELECT id, {_tok('content')} AS w FROM seen) SELECT term, id, len(w) AS dl, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM l) GROUP BY ALL")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index(spark, sf_dir).postings().select("term", "id", F.col("dl").cast("long").alias("dl"), "tf")


@query("r5_lexical_router", f"WITH {SEEN}, {_bm25_sql('b', 'seen', 'content', 'benchmark', 'text', 'item_id', 12)} SELECT query_id, id, rank, 'FTS' AS backend, 'BM25_RUNTIMEERROR' AS reason FROM b")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backend that can't answer gives way to the other, with the reason in the result."""

    def broken() -> DataFrame:
        raise RuntimeError("replica is away")

    def full_text() -> DataFrame:
        return _lexical(spark, sf_dir)

    hits, backend, reason = engine.LexicalRouter({"BM25": broken, "FTS": full_text}, "BM25").hits()
    return hits.select("query_id", "id", "rank", F.lit(backend).alias("backend"), F.lit(reason).alias("reason"))


@query("r25_identity_rerank", f"WITH {LISTS} SELECT query_id, id, rank FROM a")
def r25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("query_id", "id", "rank")


_SMOKE = [
    ("exact-a", "Fault XQ-417 means the sync agent gave up."),
    ("exact-b", "Fault XQ-418 means the login was refused."),
    ("general", "Overview of sync agent faults."),
    ("north", "Northwind 2031 Q3 sales summary. Sales rose by 4%."),
    ("south", "Southridge 2030 Q1 sales summary. Sales rose by 9%."),
]
_SMOKE_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(map(str, _SMOKE)) + ") t(id, content)), q AS (SELECT * FROM (VALUES (1, 'XQ-417'), (2, 'Northwind Q3 2031 sales')) t(qid, text))"


@query("r26_smoke_queries", f"WITH {_SMOKE_SQL}, {_bm25_sql('b', 'k', 'content', 'q', 'text', 'qid', 5)} SELECT query_id, id, score, rank FROM b")
def r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame(_SMOKE, "id string, content string")
    q = spark.createDataFrame([(1, "XQ-417"), (2, "Northwind Q3 2031 sales")], "qid int, text string")
    return R.bm25_topk(LexicalIndex(k, "id", F.col("content")), q, "text", "qid", 5).select("query_id", "id", "score", "rank")


@query("w1_row_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("rank"))


@query("w3_running_chars", "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("before"))


@query("w2_rerank_positions", f"WITH {LISTS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank FROM a")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lexical(spark, sf_dir)
    return a.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"))).alias("rank"))


@query("o4_topk_ties", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@query("u1_list_union", f"WITH {LISTS} SELECT query_id, id, min(rank) AS rank FROM (SELECT query_id, id, rank FROM v UNION ALL SELECT query_id, id, rank FROM a) GROUP BY ALL")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    return v.select("query_id", "id", "rank").unionByName(a.select("query_id", "id", "rank")).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))


@query("u2_set_intersection", f"WITH {LISTS} SELECT query_id, id FROM v INTERSECT SELECT query_id, id FROM a")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    return v.select("query_id", "id").intersect(a.select("query_id", "id"))


@query("u3_ordered_distinct", f"WITH t AS (SELECT item_id, {_tok('text')} AS w FROM benchmark) SELECT item_id, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF list_position(w, w[i]) = i], ' ') AS terms FROM t")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions.text import latin_tokens

    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_distinct(latin_tokens(F.col("text"))), " ").alias("terms"))


@query("u4_key_intersection", "SELECT doc_id FROM documents JOIN labels USING (doc_id)")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


_TIMES = """SELECT doc_id, n_chars % 500 AS total_ms, doc_id % 50 AS vector_ms, doc_id % 70 AS lexical_ms, doc_id % 9 AS rrf_ms, doc_id % 31 AS rerank_ms, CASE doc_id % 3 WHEN 0 THEN 'BM25' ELSE 'FTS' END AS lexical_backend,
 CASE doc_id % 5 WHEN 0 THEN 'BM25_TIMEOUT' WHEN 1 THEN 'RRF' END AS fallback FROM documents"""


@query("m1_metrics_frame", f"WITH t AS ({_TIMES}) SELECT *, greatest(0, total_ms - vector_ms - lexical_ms - rrf_ms - rerank_ms) AS llm_ms, CASE WHEN contains(lexical_backend, 'BM25') THEN lexical_ms ELSE 0 END AS bm25_query_latency_ms, coalesce(contains(fallback, 'BM25'), false) AS bm25_fallback FROM t")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each document, with times as its number and length have it."""
    return engine.metrics(spark.sql(_TIMES.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents")))


@query("m7_health", f"WITH {DOCS}, {CORPORA} SELECT (SELECT corpus_id FROM corpora WHERE state = 'ACTIVE') AS corpus_id, count(*) > 0 AS ready, count(*) AS documents FROM docs WHERE NOT deleted")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = corpora(spark).filter("state = 'ACTIVE'").select("corpus_id").limit(1)
    counts = documents(spark, sf_dir).filter("NOT deleted").agg(F.count("*").alias("documents"))
    return counts.crossJoin(F.broadcast(active)).select("corpus_id", (F.col("documents") > 0).alias("ready"), "documents")


@query("m8_index_health", f"WITH {SEEN}, l AS (SELECT {_tok('content')} AS w FROM seen) SELECT count(*) > 0 AS healthy FROM l WHERE list_contains(w, 'the')")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index(spark, sf_dir).terms.filter("term = 'the'").agg((F.count("*") > 0).alias("healthy"))


@query("m12_ablation", f"WITH {LISTS}, u AS (SELECT 'VECTOR' AS strategy, query_id, id FROM v UNION ALL SELECT 'KEYWORD', query_id, id FROM a) SELECT strategy, count(DISTINCT query_id) AS answered, count(*) AS hits FROM u GROUP BY strategy")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    u = v.select(F.lit("VECTOR").alias("strategy"), "query_id", "id").unionByName(a.select(F.lit("KEYWORD").alias("strategy"), "query_id", "id"))
    return u.groupBy("strategy").agg(F.countDistinct("query_id").alias("answered"), F.count("*").alias("hits"))


@query("t1_incremental_ingest", "SELECT 'corpus-a' AS corpus_id, source, CAST(doc_id AS VARCHAR) AS external_id, sha256(text) AS content_hash, 1 AS version FROM documents")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, taken in twice: the second run adds nothing."""
    from quern.streaming.ingest import SCHEMA, VersionedTable, ingest_stream

    home = new_folder(spark, "ingest")
    store = VersionedTable(spark, f"{home}/table")
    schema = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        files = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may name a file or a folder
        rows = files.select("source", F.col("doc_id").cast("string").alias("external_id"), F.col("text").alias("content"))
        ingest_stream(rows, store, f"{home}/checkpoint", "fp1")
    return store.read(SCHEMA).select("corpus_id", "source", "external_id", "content_hash", "version")


@query("t4_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the contract's list: hourly counts, the same plan as on a stream."""
    from quern.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n")
