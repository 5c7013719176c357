"""Evaluation, stratified selection and chunking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking as C
from quern.operators import evaluate as E
from quern.operators import retrieval as R
from quern.plans.q_retrieval import LISTS, _COS, _lexical, _vector
from quern.plans.registry import query
from quern.plans.relation import DOCS, documents, table

# expected: the vectors with the query's label; retrieved: its ten nearest
_JUDGED = f"""ret AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE score >= -1 QUALIFY rank <= 10),
ex AS (SELECT q.vec_id AS query_id, list(e.vec_id) AS expected FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0 GROUP BY 1),
jd AS (SELECT query_id AS question_id, expected, list(id ORDER BY rank) AS retrieved FROM ret JOIN ex USING (query_id) GROUP BY ALL),
jf AS (SELECT *, list_transform(retrieved, lambda x: CAST(list_contains(expected, x) AS INT)) AS f FROM jd),
jm AS (SELECT question_id, k, CAST(list_sum(f[1:k]) > 0 AS INT)::DOUBLE AS hit, list_sum(f[1:k]) / len(expected) AS recall, list_sum(f[1:k]) / greatest(1, len(f[1:k])) AS precision,
 coalesce(1.0 / list_position(f, 1), 0.0)::DOUBLE AS rr, CASE WHEN list_position(f, 1) <= k THEN 1.0 / list_position(f, 1) ELSE 0.0 END::DOUBLE AS truncated_rr,
 list_sum([f[i] / log2(i + 1.0) FOR i IN range(1, k + 1)]) / list_sum([1.0 / log2(i + 1.0) FOR i IN range(1, least(k, len(expected)) + 1)]) AS ndcg FROM jf, (VALUES (1), (3), (5), (10)) t(k))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 20 = 0")
    got = R.vector_topk_batch(e, asked, k=10, threshold=-1.0).groupBy(F.col("query_id").alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("retrieved"))
    by_label = e.groupBy("label").agg(F.collect_list("vec_id").alias("expected"))
    expected = asked.select(F.col("vec_id").alias("question_id"), "label").join(by_label, "label").drop("label")
    return got.join(expected, "question_id")


@query("a12_retrieval_metrics", f"WITH {_JUDGED} SELECT k, count(*) AS questions, " + ", ".join(f"floor(avg({c}) * 1e6 + 0.5) / 1e6 AS {c}" for c in ("hit", "recall", "precision", "rr", "truncated_rr", "ndcg")) + " FROM jm GROUP BY k")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.means(E.per_question(_judged(spark, sf_dir)))


@query("a17_golden_gate", f"WITH {_JUDGED} SELECT avg(rr) >= 0.70 AS mrr_ok, count(*) FILTER (WHERE rr = 0) AS misses FROM jm WHERE k = 10")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.per_question(_judged(spark, sf_dir), [10])
    return m.agg((F.avg("rr") >= 0.70).alias("mrr_ok"), F.count_if(F.col("rr") == 0).alias("misses"))


@query("j11_question_join", f"WITH {_JUDGED} SELECT question_id, len(list_intersect(expected, retrieved)) AS found FROM jd WHERE len(expected) > 0")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter(F.size("expected") > 0).select("question_id", F.size(F.array_intersect("expected", "retrieved")).cast("long").alias("found"))


@query("j13_golden_match", f"WITH {LISTS} SELECT a.query_id, coalesce(min(a.rank) FILTER (WHERE contains(d.content, b.text)), 0) AS rank FROM a JOIN docs d USING (id) JOIN benchmark b ON b.item_id = a.query_id GROUP BY a.query_id")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lexical(spark, sf_dir)
    d = documents(spark, sf_dir).select("id", "content")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    j = a.join(d, "id").join(b, "query_id")
    return j.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.contains("content", "text"), F.col("rank"))), F.lit(0)).alias("rank"))


@query(
    "a14_stratified_quotas",
    "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT source, least(n, 150 // (SELECT count(*) FROM n) + CASE WHEN row_number() OVER (ORDER BY source) - 1 < 150 % (SELECT count(*) FROM n) THEN 1 ELSE 0 END) AS quota FROM n), p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) SELECT source, doc_id, place FROM p JOIN q USING (source) WHERE place <= quota",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified(table(spark, sf_dir, "documents").select("source", "doc_id"), 150, "source", "doc_id").select("source", "doc_id", "place")


_RUNS = "SELECT source AS strategy, CASE WHEN doc_id % 2 = 0 AND source > 'src2' THEN 'FTS' ELSE 'BM25' END AS backend FROM documents"


@query("a16_backend_check", f"WITH t AS ({_RUNS}) SELECT strategy, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends, list_sort(list_distinct(list(backend))) = ['BM25'] AS ok FROM t GROUP BY strategy")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each document; its source stands for the strategy."""
    return E.backends(spark.sql(_RUNS.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents")), "BM25")


@query("a11_metric_rollup", f"WITH {LISTS}, u AS (SELECT 'vector' AS backend, * FROM v UNION ALL SELECT 'bm25', * FROM a) SELECT count(*) AS hits, count(DISTINCT id) AS documents, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends FROM u")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    u = v.withColumn("backend", F.lit("vector")).unionByName(a.withColumn("backend", F.lit("bm25")))
    return u.agg(F.count("*").alias("hits"), F.countDistinct("id").alias("documents"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"))


@query("a9_max_normalised", "WITH s AS (SELECT lang, source, sum(n_chars)::DOUBLE AS s FROM documents GROUP BY ALL), m AS (SELECT lang, max(s) AS m FROM s GROUP BY lang) SELECT lang, source, floor(s / m * 1e6 + 0.5) / 1e6 AS score FROM s JOIN m USING (lang) WHERE m > 0")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").cast("double").alias("s"))
    m = s.groupBy("lang").agg(F.max("s").alias("m")).filter("m > 0")
    return s.join(m, "lang").select("lang", "source", R.rounded(F.col("s") / F.col("m")).alias("score"))


# ---------------------------------------------------------------- chunking

_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query("c6_window_chunks", f"WITH w AS (SELECT doc_id AS id, {_W} AS w FROM documents), s AS (SELECT id, w, unnest(range(0, greatest(len(w) - 1, 0) + 1, 620)) AS start FROM w WHERE len(w) > 0) SELECT id, start, md5(array_to_string(w[start + 1:start + 700], ' ')) AS content_md5 FROM s WHERE start = 0 OR start + 80 < len(w)")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.window_chunks(table(spark, sf_dir, "documents"), 700, 80, "doc_id", "text")
    return out.select("id", F.col("start").cast("long").alias("start"), F.md5("content").alias("content_md5"))


@query("c11_fixed_windows", "WITH s AS (SELECT doc_id AS id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 1200)) AS start FROM documents) SELECT id, start // 1200 AS part, md5(substr(text, CAST(start + 1 AS INT), 1200)) AS content_md5 FROM s")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_windows(table(spark, sf_dir, "documents"), 1200, "doc_id", "text").select("id", F.col("part").cast("long").alias("part"), F.md5("content").alias("content_md5"))


@query("c15_token_counts", f"SELECT doc_id, len({_W}) AS tokens FROM documents")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions.text import token_count

    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).cast("long").alias("tokens"))


@query("c14_index_content", "SELECT doc_id, md5(substr('Source: ' || source || '. Title: ' || substr(split_part(text, chr(10), 1), 1, 500) || '.', 1, 500) || chr(10) || chr(10) || text) AS index_md5 FROM documents")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    prefix = C.metadata_prefix(F.col("source"), F.substring(F.substring_index("text", "\n", 1), 1, 500))
    return d.select("doc_id", F.md5(C.index_content(prefix, F.col("text"))).alias("index_md5"))


@query(
    "c12_document_context",
    """WITH p AS (SELECT doc_id, text, split_part(text, chr(10), 2) AS chunk, length(text) AS n FROM documents), a AS (SELECT *, greatest(0, strpos(text, chunk) - 1) AS pos FROM p),
s AS (SELECT *, greatest(200, pos - 400) AS st FROM a), e AS (SELECT *, least(n, st + 800) AS en FROM s), b AS (SELECT *, greatest(200, en - 800) AS bg FROM e)
SELECT doc_id, md5(CASE WHEN n <= 1000 THEN text ELSE substr(text, 1, 200) || chr(10) || chr(10) || '[... document excerpt omitted ...]' || chr(10) || chr(10) || substr(text, CAST(bg + 1 AS INT), CAST(en - bg AS INT)) END) AS context_md5 FROM b""",
)
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.document_context(F.col("text"), chunk, 1000)).alias("context_md5"))


@query("c9_section_category", "SELECT section, CASE WHEN contains(section, '趋势') OR contains(section, '热门仓库') OR contains(section, 'Trend') THEN 'trends' WHEN contains(section, '教育') THEN 'education' WHEN contains(section, '项目') THEN 'projects' WHEN contains(section, '技术栈') OR contains(section, '能力') THEN 'skills' ELSE 'general' END AS category FROM (VALUES ('开源趋势'), ('教育背景'), ('项目能力'), ('能力'), ('Other')) t(section)")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("开源趋势", "教育背景", "项目能力", "能力", "Other")], "section string").select("section", C.category(F.col("section")).alias("category"))


@query("c1_structured_chunks")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(documents(spark, sf_dir), C.Chunker(700, 80))


#: Three bodies of a document's text, 300 characters each at most, on one line and without the mark of headings.
_BODIES = """SELECT doc_id, source, lang, trim(replace(replace(substr(coalesce(text, ''), 1, 300), chr(10), ' '), '#', '+')) AS b1, trim(replace(replace(substr(coalesce(text, ''), 301, 300), chr(10), ' '), '#', '+')) AS b2,
 trim(replace(replace(substr(coalesce(text, ''), 601, 300), chr(10), ' '), '#', '+')) AS b3 FROM documents"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BODIES.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents"))


@query(
    "c8_markdown_sections",
    f"""WITH b AS ({_BODIES}), p AS (SELECT doc_id, source, lang, '' AS part, '## ' || lang || chr(10) || b1 AS piece, b1 AS body, 1 AS o FROM b UNION ALL SELECT doc_id, source, lang, 'more', '### more' || chr(10) || b2, b2, 2 FROM b
 UNION ALL SELECT doc_id, source, '概览', '', b3, b3, 0 FROM b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS n, source AS title, lang AS section, part AS subsection, md5(trim(piece)) AS piece_md5, lang || '-1' AS meta FROM (SELECT p.*, d.lang AS meta_lang FROM p JOIN documents d USING (doc_id)) WHERE body <> ''""".replace("lang || '-1' AS meta", "meta_lang || '-1' AS meta"),
)
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a knowledge file: front matter, a title, text before any section, a section and a part of it."""
    import pandas as pd

    lines = [F.lit("---"), F.concat(F.lit("key: "), "lang", F.lit("-1")), F.lit("---"), F.concat(F.lit("# "), "source"), F.col("b3"), F.concat(F.lit("## "), "lang"), F.col("b1"), F.lit("### more"), F.col("b2")]

    def run(batches):
        for pdf in batches:
            out = [(i, n, title, section, part, piece, meta["key"]) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for n, (title, section, part, piece, meta) in enumerate(C.split_markdown(t))]
            yield pd.DataFrame(out, columns=["doc_id", "n", "title", "section", "subsection", "piece", "meta"])

    files = _bodies(spark, sf_dir).select("doc_id", F.concat_ws("\n", *lines).alias("text"))
    rows = files.mapInPandas(run, "doc_id long, n int, title string, section string, subsection string, piece string, meta string")
    return rows.withColumn("piece_md5", F.md5("piece")).drop("piece")


@query(
    "c5_packed_sections",
    f"""WITH b AS ({_BODIES}), p AS (SELECT doc_id, 0 AS chunk_index, 'Doc > ' || source AS section_path, '# ' || source || CASE WHEN b1 <> '' THEN chr(10) || b1 ELSE '' END || CASE WHEN b2 <> '' THEN chr(10) || chr(10) || b2 ELSE '' END AS content FROM b
 UNION ALL SELECT doc_id, 1, 'Doc > ' || source || ' > ' || lang, '## ' || lang || CASE WHEN b3 <> '' THEN chr(10) || b3 ELSE '' END FROM b)
SELECT CAST(doc_id AS VARCHAR) AS id, chunk_index, section_path, md5(content) AS content_md5, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS token_count FROM p""",
)
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one section in one chunk, those of another apart, with the path of headings that leads to them."""
    text = F.concat(F.lit("# "), "source", F.lit("\n"), "b1", F.lit("\n\n"), "b2", F.lit("\n## "), "lang", F.lit("\n"), "b3")
    docs = _bodies(spark, sf_dir).select(F.col("doc_id").alias("id"), text.alias("content"), F.lit("Doc").alias("title"))
    return C.chunk_documents(docs, C.Chunker(700, 80)).withColumn("content_md5", F.md5("content")).drop("content")


@query("c16_hash_embedding")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.providers import embed

    return embed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("j1_chunk_document_join", f"WITH {DOCS}, s AS (SELECT id, content, unnest(range(0, greatest(length(content) - 1, 0) + 1, 1200)) AS start FROM docs) SELECT d.department, count(*) AS chunks FROM s JOIN docs d USING (id) GROUP BY d.department")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return C.fixed_windows(d, 1200, "id", "content").join(d.select("id", "department"), "id").groupBy("department").agg(F.count("*").alias("chunks"))


_KNOWLEDGE = [
    ("a.md", "# Me\n## 教育背景\nschool\n## 项目\n### Thing\nbuilt it\n"),
    ("t.md", "---\ndocument_type: github_trend\nsnapshot_date: 2030-01-01\nexpires_at: 2030-01-15\nanalysis_date: 2029-12-01\n---\n## 自动快照\nrows\n## 分析\nwords\n"),
]


@query(
    "c10_knowledge_metadata",
    """SELECT * FROM (VALUES ('a.md:0', 'education', '教育背景', '', 'education,教育背景,教育背景', NULL, NULL), ('a.md:1', 'projects', 'Thing', 'Thing', 'projects,项目,Thing', NULL, NULL),
 ('t.md:0', 'trends', '自动快照', '', 'trends,自动快照,自动快照', '2030-01-01', '2030-01-15'), ('t.md:1', 'trends', '分析', '', 'trends,分析,分析', '2029-12-01', '2030-01-15')) t(chunk_id, category, topic, project, keywords, snapshot_date, expires_at)""",
)
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.knowledge_chunks(spark.createDataFrame(_KNOWLEDGE, "source string, text string"))
    return out.select("chunk_id", "category", "topic", "project", "keywords", "snapshot_date", "expires_at")


@query("h6_pipeline_fingerprint", """SELECT sha256('{"chunk": 700, "model": "hash", "overlap": 80}') AS fingerprint""")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.ingest import pipeline_fingerprint

    return spark.range(1).select(F.lit(pipeline_fingerprint({"model": "hash", "overlap": 80, "chunk": 700})).alias("fingerprint"))


@query("j12_outside_ids", f"WITH {LISTS} SELECT query_id, id FROM a WHERE id % 2 = 0")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids named from outside, looked up among the hits; what wasn't a hit is dropped."""
    a = _lexical(spark, sf_dir)
    named = a.filter("id % 2 = 0").select("query_id", "id").unionByName(a.select("query_id", F.lit(-5).cast("long").alias("id")))
    return a.select("query_id", "id").join(named, ["query_id", "id"], "left_semi")
