"""Ranked retrieval over the driver's tables; benchmark items are the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval as R
from quern.operators.access import AccessContext, visible, with_contexts
from quern.operators.index import LexicalIndex
from quern.operators.corpus import freshness_note
from quern.plans.q_ingest import _DATES, _dated
from quern.plans.registry import query
from quern.plans.relation import CORPORA, DOCS, LIVE, corpora, documents, live, table
from quern.sources.tables import written

READER = AccessContext.of("engineering", None)


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(documents(spark, sf_dir), corpora(spark)).filter(READER.predicate())


SEEN = f"{DOCS}, {CORPORA}, {LIVE}, seen AS (SELECT * FROM live WHERE (access_level = 'public' OR department = 'engineering') AND tenant_id = 'default')"


def _tok(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9+#.]{{2,}}')"


def _bm25_sql(name: str, docs: str, text: str, queries: str, qtext: str, qid: str, k: int | None = None) -> str:
    """CTEs that end in `name`(query_id, id, score[, rank])."""
    n = name
    top = f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {n}_s QUALIFY rank <= {k}" if k else f"SELECT * FROM {n}_s"
    return f"""{n}_l AS (SELECT id, {_tok(text)} AS w FROM {docs}),
{n}_st AS (SELECT count(*) AS n_docs, greatest(1.0, avg(len(w))) AS avg_len FROM {n}_l),
{n}_p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {n}_l) GROUP BY ALL),
{n}_q AS (SELECT DISTINCT {qid} AS query_id, unnest({_tok(qtext)}) AS term FROM {queries}),
{n}_df AS (SELECT term, count(*) AS df FROM {n}_p GROUP BY term),
{n}_s AS (SELECT query_id, id, floor(sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1.0 - 0.75 + 0.75 * dl / avg_len))) * 1e6 + 0.5) / 1e6 AS score
  FROM {n}_p JOIN {n}_df USING (term) JOIN {n}_q USING (term), {n}_st GROUP BY query_id, id),
{n} AS ({top})"""


_INDEXES: dict[tuple[str, str, str], LexicalIndex] = {}


def lexical_index(spark: SparkSession, sf_dir: str, column: str = "content") -> LexicalIndex:
    """The index of what READER may see, written once a session and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, column)
    if key not in _INDEXES:
        _INDEXES[key] = LexicalIndex(_visible(spark, sf_dir), "id", F.col(column))
    return _INDEXES[key]


def _lexical(spark: SparkSession, sf_dir: str, column: str = "content") -> DataFrame:
    return R.bm25_topk(lexical_index(spark, sf_dir, column), table(spark, sf_dir, "benchmark"), "text", "item_id", 12)


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return R.vector_topk_batch(e, e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"))


@query("r3_bm25_topk", f"WITH {SEEN}, {_bm25_sql('b', 'seen', 'content', 'benchmark', 'text', 'item_id', 12)} SELECT query_id, id, score, rank FROM b")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)


@query("a7_bm25_statistics", f"WITH {SEEN}, l AS (SELECT id, {_tok('content')} AS w FROM seen) SELECT term, count(DISTINCT id) AS df, count(*) AS occurrences FROM (SELECT id, unnest(w) AS term FROM l) GROUP BY term")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_index(spark, sf_dir).postings()
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


_COS = "floor(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6"


@query("r1_vector_topk", f"SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 12")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.vector_topk(e, list(e.filter("vec_id = 0").first()["embedding"]))


@query("r1_vector_batch", f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE score >= 0.2 QUALIFY rank <= 12")
def r1_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.vector_topk_batch(e, e.filter("vec_id % 20 = 0"))


_VECTORS: dict[tuple[str, str], DataFrame] = {}


def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and w, the words of every document, written once a session: what the derived search column is to a stored table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VECTORS:
        _VECTORS[key] = written(documents(spark, sf_dir).select("id", R.fts_words(F.col("content")).alias("w")), "search-vectors")
    return _VECTORS[key]


_FTS = "list_contains(w, 'the') AND NOT list_contains(w, 'idiot') AND list_contains(list_transform(range(1, len(w)), lambda i: w[i:i + 1]), ['of', 'the']) OR list_contains(w, 'der')"


@query(
    "r2_fts_match",
    f"""WITH {SEEN}, w AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM docs)
SELECT id, len(w) AS words FROM w WHERE {_FTS}""",
)
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(spark, sf_dir).filter(R.fts_match(F.col("w"), 'the "of the" -idiot or der')).select("id", F.size("w").cast("long").alias("words"))


@query(
    "r2_fts_topk",
    f"""WITH {DOCS}, w AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM docs),
s AS (SELECT id, floor(len(list_filter(w, lambda x: x IN ('der', 'of', 'the'))) / (1.0 + ln(len(w) + 1.0)) * 1e6 + 0.5) / 1e6 AS score FROM w WHERE {_FTS})
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 12""",
)
def r2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fts_topk(search_vectors(spark, sf_dir), 'the "of the" -idiot or der', "id", "w")


# two lexical lists and a vector list for each benchmark item

LISTS = f"""{SEEN}, {_bm25_sql('a', 'seen', 'content', 'benchmark', 'text', 'item_id', 12)}, {_bm25_sql('t', 'seen', 'title', 'benchmark', 'text', 'item_id', 12)},
v AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)) WHERE score >= 0.2 QUALIFY rank <= 12)"""


def _rrf_sql(lists: list[str], n: int, name: str = "f") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, rank FROM {x}" for x in lists)
    return f"""{name}_s AS (SELECT query_id, id, floor(sum(1.0::DOUBLE / (60 + rank)) * 1e9 + 0.5) / 1e9 AS score FROM ({union}) GROUP BY ALL),
{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s QUALIFY rank <= {n})"""


@query("r6_rrf_two_lists", f"WITH {LISTS}, {_rrf_sql(['v', 'a'], 15)} SELECT query_id, id, score, rank FROM f")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    return R.rrf([v, a], 15, by=["query_id"])


@query("r7_rrf_many_lists", f"WITH {LISTS}, {_rrf_sql(['v', 'a', 't'], 15)} SELECT query_id, id, score, rank FROM f")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t, v = _lexical(spark, sf_dir), _lexical(spark, sf_dir, "title"), _vector(spark, sf_dir)
    return R.rrf([v, a, t], 15, by=["query_id"])


@query("a10_candidate_count", f"WITH {LISTS} SELECT query_id, count(DISTINCT id) AS candidates FROM (SELECT query_id, id FROM v UNION ALL SELECT query_id, id FROM a) GROUP BY query_id")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    return v.select("query_id", "id").unionByName(a.select("query_id", "id")).groupBy("query_id").agg(F.countDistinct("id").alias("candidates"))


@query("j8_ranked_list_merge", f"WITH {LISTS}, u AS (SELECT *, 0 AS l, 'vector' AS origin FROM v UNION ALL SELECT *, 1, 'lexical' FROM a) SELECT query_id, id, arg_min(origin, l) AS origin, count(*) AS lists FROM u GROUP BY query_id, id")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    both = v.withColumn("l", F.lit(0)).withColumn("origin", F.lit("vector")).unionByName(a.withColumn("l", F.lit(1)).withColumn("origin", F.lit("lexical")))
    return both.groupBy("query_id", "id").agg(F.min_by("origin", "l").alias("origin"), F.count("*").alias("lists"))


_RTOK = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_.:/-]+'), lambda t: length(t) > 1))"
_Q, _W, _TT = _RTOK.format("q"), _RTOK.format("substr(content, 1, 1600)"), _RTOK.format("title")


def _rerank_sql(source: str, name: str) -> str:
    return f"""{name}_h AS (SELECT x.query_id, x.id, x.rank, b.text AS q, coalesce(d.content, '') AS content, coalesce(d.title, '') AS title, d.source FROM {source} x JOIN benchmark b ON b.item_id = x.query_id JOIN docs d ON d.id = x.id),
{name}_s AS (SELECT query_id, id, content, title, source, floor((0.55 * (len(list_intersect({_Q}, {_W})) / len({_Q})) + 0.20 * (len(list_intersect({_Q}, {_TT})) / len({_Q}))
  + CASE WHEN contains(lower(substr(content, 1, 1600)), lower(trim(q, ' '))) THEN 0.10 ELSE 0.0 END + 0.15 / rank) * 1e6 + 0.5) / 1e6 AS score FROM {name}_h),
{name} AS (SELECT query_id, id, content, title, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s)"""


def _filled(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """Hits with the query's and the document's text."""
    d = documents(spark, sf_dir).select("id", "content", "title", "source")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return hits.join(b, "query_id").join(d, "id")


@query("r8_heuristic_rerank", f"WITH {LISTS}, {_rrf_sql(['v', 'a'], 15)}, {_rerank_sql('f', 'r')} SELECT query_id, id, score, rank FROM r")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    hits = _filled(spark, sf_dir, R.rrf([v, a], 15, by=["query_id"]))
    return R.heuristic_rerank(hits, F.col("q"), ["query_id"]).select("query_id", "id", "score", "rank")


def _budget(source: str, name: str, k: int = 5, chars: int = 9000) -> str:
    return f"""{name}_b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {source} WHERE trim(regexp_replace(content, '[\\x00-\\x20]', ' ', 'g'), ' ') <> ''),
{name}_c AS (SELECT * REPLACE (substr(content, 1, CAST({chars} - used AS INT)) AS content) FROM {name}_b WHERE used < {chars}),
{name} AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM {name}_c WHERE trim(content, ' ') <> '' QUALIFY new_rank <= {k})"""


@query("r20_context_budget", f"WITH {LISTS}, {_rrf_sql(['v', 'a'], 15)}, {_rerank_sql('f', 'r')}, {_budget('r', 'g')} SELECT query_id, id, new_rank AS rank, md5(content) AS content_md5, length(content) AS chars FROM g")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    hits = R.heuristic_rerank(_filled(spark, sf_dir, R.rrf([v, a], 15, by=["query_id"])), F.col("q"), ["query_id"])
    return R.within_budget(hits, ["query_id"]).select("query_id", "id", "rank", F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("chars"))


@query(
    "r21_strategies",
    f"""WITH {LISTS}, {_rrf_sql(['v', 'a'], 15)}, {_rerank_sql('f', 'r')}, d AS (SELECT id, coalesce(content, '') AS content FROM docs),
sv AS (SELECT v.*, content FROM v JOIN d USING (id)), sk AS (SELECT a.*, content FROM a JOIN d USING (id)), sh AS (SELECT f.*, content FROM f JOIN d USING (id)),
{_budget('sv', 'gv')}, {_budget('sk', 'gk')}, {_budget('sh', 'gh')}, {_budget('r', 'gr')}
SELECT 'VECTOR' AS strategy, query_id, id, score, new_rank AS rank FROM gv UNION ALL SELECT 'KEYWORD', query_id, id, score, new_rank FROM gk
UNION ALL SELECT 'HYBRID', query_id, id, score, new_rank FROM gh UNION ALL SELECT 'HYBRID_RERANK', query_id, id, score, new_rank FROM gr""",
)
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four strategies; vector and keyword keep their raw scores."""
    a, v = written(_lexical(spark, sf_dir), "hits"), written(_vector(spark, sf_dir), "hits")  # each is read three times
    fused = written(R.rrf([v, a], 15, by=["query_id"]), "hits")
    ways = {"VECTOR": v, "KEYWORD": a, "HYBRID": fused}
    out = [R.within_budget(_filled(spark, sf_dir, x), ["query_id"]).withColumn("strategy", F.lit(name)) for name, x in ways.items()]
    out.append(R.within_budget(R.heuristic_rerank(_filled(spark, sf_dir, fused), F.col("q"), ["query_id"]), ["query_id"]).withColumn("strategy", F.lit("HYBRID_RERANK")))
    return reduce(DataFrame.unionByName, [x.select("strategy", "query_id", "id", "score", "rank") for x in out])


@query(
    "r23_query_expansion",
    f"""WITH {SEEN}, rw AS (SELECT item_id, text, list_distinct(list_transform(string_split(text, '. '), lambda r: trim(r, ' '))) AS x FROM benchmark),
e AS (SELECT item_id, 0 AS part, text AS t FROM rw UNION ALL SELECT item_id, part, y[part] AS t FROM (SELECT item_id, unnest(range(1, 3)) AS part, (list_filter(string_split(text, '. '), lambda r: trim(r, ' ') <> '' AND lower(trim(r, ' ')) <> lower(trim(text, ' ')))) AS y FROM rw) WHERE part <= len(y)),
k AS (SELECT item_id * 10 + part AS qid, * FROM e), {_bm25_sql('a', 'seen', 'content', 'k', 't', 'qid', 5)},
z AS (SELECT query_id // 10 AS query_id, id, rank FROM a), {_rrf_sql(['z'], 5)} SELECT query_id, id, score, rank FROM f""",
)
def r23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item and its first sentences as rewrites, retrieved with the same access and fused."""
    items = table(spark, sf_dir, "benchmark").withColumn("rw", F.split("text", r"\. "))
    items = items.withColumn("rw", R.clean_rewrites(items, F.col("text"), "rw"))
    asked = items.select((F.col("item_id") * 10).alias("qid"), F.posexplode(F.concat(F.array("text"), "rw")).alias("part", "t")).select((F.col("qid") + F.col("part")).alias("qid"), "t")
    found = R.bm25_topk(lexical_index(spark, sf_dir), asked, "t", "qid", 5)
    return R.rrf([found.select(F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), "id", "rank")], 5, by=["query_id"])


@query(
    "r24_rewrite_cleaning",
    """WITH u AS (SELECT conv_id, turn, text, list_transform(string_split(text, '. '), lambda r: trim(r, ' ')) AS x FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([x[i] FOR i IN range(1, len(x) + 1) IF list_position(x, x[i]) = i], lambda r: r <> '' AND lower(r) <> lower(trim(text, ' ')))[1:2], '|') AS rewrites FROM u""",
)
def r24(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("rw", F.split("text", r"\. "))
    return c.select("conv_id", "turn", F.array_join(R.clean_rewrites(c, F.col("text"), "rw"), "|").alias("rewrites"))


@query(
    "r9b_outside_order",
    f"""WITH {LISTS}, o AS (SELECT query_id, id, min(position) AS position FROM (SELECT query_id, id, 13 - rank AS position FROM a WHERE id % 3 = 0 UNION ALL SELECT query_id, -1, 0 FROM a) GROUP BY ALL)
SELECT a.query_id, a.id, row_number() OVER (PARTITION BY a.query_id ORDER BY position NULLS LAST, a.rank, a.id) AS rank FROM a LEFT JOIN o ON a.query_id = o.query_id AND a.id = o.id""",
)
def r9b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside re-ranker that returns some hits in reverse and ids that no one asked for."""
    a = _lexical(spark, sf_dir)
    order = a.filter("id % 3 = 0").select("query_id", "id", (13 - F.col("rank")).alias("position"))
    order = order.unionByName(a.select("query_id", F.lit(-1).cast("long").alias("id"), F.lit(0).alias("position")))
    return R.merge_order(a.select("query_id", "id", "rank"), order, ["query_id"])


@query(
    "r22_fallback_lattice",
    """WITH f AS (SELECT doc_id, doc_id % 2 = 0 AS v, doc_id % 3 = 0 AS l, doc_id % 5 = 0 AS r, CASE doc_id % 7 WHEN 0 THEN 'BM25_TIMEOUT' WHEN 1 THEN ' ' END AS reason FROM documents),
c AS (SELECT doc_id, CASE WHEN v AND l THEN 'EVIDENCE_ONLY' WHEN v THEN 'FTS_ONLY' WHEN l THEN 'VECTOR_ONLY' WHEN r THEN 'RRF' END AS code, nullif(trim(reason), '') AS reason FROM f)
SELECT doc_id, nullif(concat_ws(',', code, reason), '') AS fallback FROM c""",
)
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each document, with the sides that fail as its number has it."""
    n = F.col("doc_id")
    reason = F.when(n % 7 == 0, "BM25_TIMEOUT").when(n % 7 == 1, " ")
    return table(spark, sf_dir, "documents").select("doc_id", R.fallback_code(n % 2 == 0, n % 3 == 0, n % 5 == 0, reason).alias("fallback"))


_CONTEXTS = [(1, "admin", None), (2, "ENGINEERING ", "default"), (3, "finance", None), (4, "hr", "tenant-b"), (5, "nobody", ""), (6, None, None)]
_CONTEXTS_SQL = "c AS (SELECT context_id, role, CASE WHEN trim(coalesce(t, '')) <> '' THEN trim(t) WHEN role <> 'admin' THEN 'default' END AS tenant_id, CASE WHEN role IN ('engineering', 'finance', 'hr') THEN role END AS department FROM (SELECT context_id, CASE WHEN lower(trim(coalesce(r, ''))) IN ('public', 'admin', 'engineering', 'finance', 'hr') THEN lower(trim(r)) ELSE 'public' END AS role, t FROM (VALUES (1, 'admin', NULL), (2, 'ENGINEERING ', 'default'), (3, 'finance', NULL), (4, 'hr', 'tenant-b'), (5, 'nobody', ''), (6, NULL, NULL)) x(context_id, r, t)))"


def _contexts(spark: SparkSession) -> DataFrame:
    return with_contexts(spark.createDataFrame(_CONTEXTS, "context_id int, r string, t string"), "r", "t").drop("r", "t")


@query(
    "p2_access_contexts",
    """WITH x AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'admin' WHEN 1 THEN 'ENGINEERING ' WHEN 2 THEN 'finance' WHEN 3 THEN ' hr' WHEN 4 THEN source WHEN 5 THEN NULL ELSE 'Public' END AS r, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' t-' || lang END AS t FROM documents),
c AS (SELECT doc_id, CASE WHEN lower(trim(coalesce(r, ''))) IN ('public', 'admin', 'engineering', 'finance', 'hr') THEN lower(trim(r)) ELSE 'public' END AS role, t FROM x)
SELECT doc_id, role, CASE WHEN trim(coalesce(t, '')) <> '' THEN trim(t) WHEN role <> 'admin' THEN 'default' END AS tenant_id, CASE WHEN role IN ('engineering', 'finance', 'hr') THEN role END AS department FROM c""",
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each document, its role and tenant as its number has it."""
    n = F.col("doc_id")
    role = F.when(n % 7 == 0, "admin").when(n % 7 == 1, "ENGINEERING ").when(n % 7 == 2, "finance").when(n % 7 == 3, " hr").when(n % 7 == 4, F.col("source")).when(n % 7 == 6, "Public")
    tenant = F.when(n % 3 == 1, " ").when(n % 3 == 2, F.concat(F.lit(" t-"), "lang"))
    asked = table(spark, sf_dir, "documents").select("doc_id", role.alias("r"), tenant.alias("t"))
    return with_contexts(asked, "r", "t").select("doc_id", "role", "tenant_id", "department")


@query(
    "p1_acl_matrix",
    f"WITH {DOCS}, {_CONTEXTS_SQL} SELECT context_id, id FROM c, docs d WHERE (c.role = 'admin' OR d.access_level = 'public' OR d.department = c.department) AND (c.tenant_id IS NULL OR d.tenant_id = c.tenant_id)",
)
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(_contexts(spark), documents(spark, sf_dir)).select("context_id", "id")


@query("p3_live_documents", f"WITH {DOCS}, {CORPORA}, {LIVE} SELECT id, corpus_id FROM live")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(documents(spark, sf_dir), corpora(spark)).select("id", "corpus_id")


@query("p8_source_frames", f"""WITH {LISTS}, j AS (SELECT a.query_id, a.rank, d.external_id, d.source, d.title FROM a JOIN docs d USING (id)) SELECT query_id, string_agg(external_id || '@' || source || '#' || rank, ';' ORDER BY rank) AS frame FROM j GROUP BY query_id""")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lexical(spark, sf_dir)
    j = a.join(documents(spark, sf_dir).select("id", "external_id", "source"), "id")
    one = F.concat("external_id", F.lit("@"), "source", F.lit("#"), "rank")
    return j.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("x")))), lambda s: s["x"]), ";").alias("frame"))


@query(
    "p9_grounded_context",
    f"""WITH {LISTS}, j AS (SELECT a.query_id, a.rank, '[' || d.source_type || ' | ' || d.title || ' | ' || d.external_id || ']' || chr(10) || coalesce(d.content, '') AS t FROM a JOIN docs d USING (id))
SELECT b.item_id AS query_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY rank), 'insufficient evidence')) AS context_md5 FROM benchmark b LEFT JOIN j ON j.query_id = b.item_id GROUP BY b.item_id""",
)
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lexical(spark, sf_dir)
    d = documents(spark, sf_dir)
    block = F.concat(F.lit("["), "source_type", F.lit(" | "), "title", F.lit(" | "), "external_id", F.lit("]\n"), F.coalesce("content", F.lit("")))
    j = a.join(d.select("id", block.alias("t")), "id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda s: s["t"]), "\n\n").alias("c"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return b.join(j, "query_id", "left").select("query_id", F.md5(F.coalesce("c", F.lit("insufficient evidence"))).alias("context_md5"))


_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "p10_escaped_context",
    f"WITH {_DATES} SELECT page_id, md5('<document source=\"' || {_ESCAPED.format('url')} || '\" section=\"' || {_ESCAPED.format('snap')} || '\" freshness=\"' || {_ESCAPED.format('note')} || '\">' || chr(10) || html || chr(10) || '</document>') AS context_md5 FROM fresh",
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a document of the answer's context, with its snapshot's note; the snapshot's date stands for a section."""
    d = _dated(spark, sf_dir)
    named = {"source": F.col("url"), "section": F.col("snap"), "freshness": freshness_note(F.col("snap"), F.col("e"), "2030-06-15")}
    head = F.concat_ws(" ", *(F.concat(F.lit(f'{k}="'), T.xml_escape(v), F.lit('"')) for k, v in named.items()))
    return d.select("page_id", F.md5(F.concat(F.lit("<document "), head, F.lit(">\n"), "html", F.lit("\n</document>"))).alias("context_md5"))


# ---------------------------------------------------------------- lexical scoring with intents

# Fixed values of the intent rules: the first rule with a word in the question decides; the trend rule comes before them.
INTENTS = [
    (["工作", "经历", "公司"], ["career"]),
    (["教育", "学校", "学历", "大学", "专业", "毕业"], ["education"]),
    (["项目", "作品", "做过", "开发过", "rag"], ["projects"]),
    (["技术栈", "技术", "能力", "熟悉", "java", "spring", "python", "ai agent"], ["skills", "projects", "career"]),
    (["联系", "邮箱", "电话", "github", "博客"], ["basic"]),
    (["兴趣", "性格", "爱好", "理念"], ["interests", "personality"]),
    (["定位", "求职", "目标", "岗位"], ["positioning", "goals"]),
]
TREND_PAIRS = [(["github"], ["趋势", "热门", "火爆", "值得关注"]), (["插件", "plugin", "skill"], ["趋势", "热门", "生态", "分发"])]
TREND_WORDS = ["github trend", "github trending", "github趋势", "开源趋势", "热门仓库"]
COMPREHENSIVE = ["全部", "所有", "完整", "详细", "全面", "总览", "一览"]
RECENT = ["最近", "最新", "本周", "当前", "现在"]


def any_of(c: F.Column, words: list[str]) -> F.Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def intent(question: F.Column) -> F.Column:
    """Categories that the question asks for; empty if none."""
    q = F.lower(F.coalesce(question, F.lit("")))
    trend = reduce(lambda a, b: a | b, [any_of(q, x) & any_of(q, y) for x, y in TREND_PAIRS], any_of(q, TREND_WORDS))
    out = F.when(trend, F.array(F.lit("trends")))
    for words, names in INTENTS:
        out = out.when(any_of(q, words), F.array(*map(F.lit, names)))
    return out.otherwise(F.array().cast("array<string>"))


def budget_of(question: F.Column, k: int = 4, chars: int = 4800) -> tuple[F.Column, F.Column]:
    wide = any_of(F.lower(F.coalesce(question, F.lit(""))), COMPREHENSIVE)
    return F.when(wide, max(k, 8)).otherwise(k), F.when(wide, max(chars, 10_000)).otherwise(chars)


def metadata_score(question: F.Column, categories: F.Column, category: F.Column, section: F.Column, topic: F.Column, project: F.Column, named: list[str]) -> F.Column:
    """Recent trends, then named things, then categories: the first that applies. `named` is the deployment's own list."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F.when(F.array_contains(categories, "trends") & any_of(q, RECENT), F.when(F.contains(section, F.lit("自动快照")), 1.0).otherwise(0.65))
    for name in named:
        hit = F.contains(F.lower(topic), F.lit(name)) | F.contains(F.lower(project), F.lit(name))
        out = out.when(F.contains(q, F.lit(name)), F.when(hit, 1.0).otherwise(0.1))
    return out.when(F.array_contains(categories, category), 0.8).otherwise(0.0)


def hybrid_score(vector: F.Column, bm25: F.Column, metadata: F.Column) -> F.Column:
    boost = F.when(metadata >= 0.75, 0.30).otherwise(0.0)
    return F.when(vector == 0.0, bm25 * 0.45 + metadata * 0.55 + boost).otherwise(vector * 0.45 + bm25 * 0.35 + metadata * 0.20 + boost)


_ASKED = [(1, "GitHub Trending 最近有什么"), (2, "公司经历"), (3, "大学 专业"), (4, "哪些项目 RAG"), (5, "熟悉 Python 吗, 全部"), (6, "邮箱"), (7, "爱好"), (8, "目标 岗位 详细"), (9, "hello"), (10, None), (11, "plugin 生态"), (12, "hadoop")]
_ASKED_SQL = "ph AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in _ASKED) + ") t(i, phrase)), q AS (SELECT conv_id * 1000 + turn AS qid, phrase || ' ' || text AS question FROM conversations JOIN ph ON i = (conv_id + turn) % 12 + 1)"


def _any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_INTENT_SQL = (
    f"CASE WHEN {_any_sql('l', TREND_WORDS)} OR (contains(l, 'github') AND {_any_sql('l', ['趋势', '热门', '火爆', '值得关注'])}) OR ({_any_sql('l', ['插件', 'plugin', 'skill'])} AND {_any_sql('l', ['趋势', '热门', '生态', '分发'])}) THEN 'trends' "
    + " ".join(f"WHEN {_any_sql('l', w)} THEN '{','.join(c)}'" for w, c in INTENTS)
    + " ELSE '' END"
)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations, led by a phrase that asks for something; where that is null, so is the question."""
    phrases = F.array(*(F.lit(t).cast("string") for _, t in _ASKED))
    at = ((F.col("conv_id") + F.col("turn")) % 12 + 1).cast("int")
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(F.element_at(phrases, at), F.lit(" "), "text").alias("question"))


@query("r13_intent", f"WITH {_ASKED_SQL}, z AS (SELECT qid, lower(coalesce(question, '')) AS l FROM q) SELECT qid, {_INTENT_SQL} AS categories FROM z")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("qid", F.array_join(intent(F.col("question")), ",").alias("categories"))


@query("r18_budget_widening", f"WITH {_ASKED_SQL}, z AS (SELECT qid, {_any_sql('lower(coalesce(question, chr(32)))', COMPREHENSIVE)} AS wide FROM q) SELECT qid, CASE WHEN wide THEN 8 ELSE 4 END AS k, CASE WHEN wide THEN 10000 ELSE 4800 END AS chars FROM z")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, chars = budget_of(F.col("question"))
    return _asked(spark, sf_dir).select("qid", k.alias("k"), chars.alias("chars"))


_CHUNKS = [("c1", "career", "职业生涯", "hadoop", ""), ("c2", "projects", "项目", "rag", "widget"), ("c3", "trends", "自动快照", "", ""), ("c4", "trends", "分析", "plugin", ""), ("c5", "skills", "技术栈", "", "")]
_CHUNKS_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(map(str, _CHUNKS)) + ") t(chunk_id, category, section, topic, project))"
NAMED = ["widget", "databricks", "hadoop"]


@query(
    "r14_metadata_score",
    f"""WITH {_ASKED_SQL}, {_CHUNKS_SQL}, z AS (SELECT qid, lower(coalesce(question, '')) AS l FROM q), y AS (SELECT *, string_split({_INTENT_SQL}, ',') AS cats FROM z)
SELECT qid, chunk_id, CAST(CASE WHEN list_contains(cats, 'trends') AND {_any_sql('l', RECENT)} THEN CASE WHEN contains(section, '自动快照') THEN 1.0 ELSE 0.65 END
""" + " ".join(f"WHEN contains(l, '{n}') THEN CASE WHEN contains(lower(topic), '{n}') OR contains(lower(project), '{n}') THEN 1.0 ELSE 0.1 END" for n in NAMED) + """ WHEN list_contains(cats, category) THEN 0.8 ELSE 0.0 END AS DOUBLE) AS metadata_score FROM y, k""",
)
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _asked(spark, sf_dir).withColumn("cats", intent(F.col("question")))
    k = spark.createDataFrame(_CHUNKS, "chunk_id string, category string, section string, topic string, project string")
    score = metadata_score(F.col("question"), F.col("cats"), F.col("category"), F.col("section"), F.col("topic"), F.col("project"), NAMED)
    return q.crossJoin(F.broadcast(k)).select("qid", "chunk_id", score.alias("metadata_score"))


@query(
    "r10_normalised_bm25",
    f"WITH {SEEN}, {_bm25_sql('b', 'seen', 'content', 'benchmark', 'text', 'item_id')}, m AS (SELECT query_id, max(score) AS top FROM b GROUP BY query_id) SELECT query_id, id, floor(score / top * 1e6 + 0.5) / 1e6 AS score FROM b JOIN m USING (query_id) WHERE top > 0",
)
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.bm25_scores(lexical_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "text", "item_id")
    top = s.groupBy("query_id").agg(F.max("score").alias("top")).filter("top > 0")
    return s.join(top, "query_id").select("query_id", "id", R.rounded(F.col("score") / F.col("top")).alias("score"))


@query(
    "r15_hybrid_fusion",
    f"""WITH {LISTS}, m AS (SELECT query_id, max(score) AS top FROM a GROUP BY query_id),
u AS (SELECT query_id, id, max(vs) AS vs, max(bs) AS bs FROM (SELECT query_id, id, score AS vs, 0.0::DOUBLE AS bs FROM v UNION ALL SELECT query_id, id, 0.0::DOUBLE, score / top FROM a JOIN m USING (query_id) WHERE top > 0) GROUP BY ALL),
s AS (SELECT query_id, u.id, vs, bs, CASE WHEN d.lang = 'de' THEN 0.8 ELSE 0.0 END::DOUBLE AS ms FROM u JOIN documents d ON d.doc_id = u.id),
f AS (SELECT query_id, id, floor((CASE WHEN vs = 0.0 THEN bs * 0.45 + ms * 0.55 ELSE vs * 0.45 + bs * 0.35 + ms * 0.20 END + CASE WHEN ms >= 0.75 THEN 0.30 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS score FROM s)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f WHERE score > 0.05""",
)
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, v = _lexical(spark, sf_dir), _vector(spark, sf_dir)
    top = a.groupBy("query_id").agg(F.max("score").alias("top")).filter("top > 0")
    zero = F.lit(0.0)
    both = v.select("query_id", "id", F.col("score").alias("vs"), zero.alias("bs")).unionByName(a.join(top, "query_id").select("query_id", "id", zero.alias("vs"), (F.col("score") / F.col("top")).alias("bs")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", 0.8).otherwise(0.0).alias("ms"))
    s = both.groupBy("query_id", "id").agg(F.max("vs").alias("vs"), F.max("bs").alias("bs")).join(d, "id")
    s = s.select("query_id", "id", R.rounded(hybrid_score(F.col("vs"), F.col("bs"), F.col("ms"))).alias("score")).filter("score > 0.05")
    return R.ranked(s, ["query_id"], "score", "id").select("query_id", "id", "score", "rank")


@query("r16_vector_retry", f"WITH {LISTS}, n AS (SELECT v.*, d.lang FROM v JOIN documents d ON d.doc_id = v.id), h AS (SELECT query_id, count(*) FILTER (WHERE lang = 'de') AS c FROM n GROUP BY query_id) SELECT query_id, id, score FROM n JOIN h USING (query_id) WHERE c < 2 OR lang = 'de'")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered search with fewer than two hits is done again without the filter."""
    v = _vector(spark, sf_dir)
    n = v.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    h = n.groupBy("query_id").agg(F.count_if(F.col("lang") == "de").alias("c"))
    return n.join(h, "query_id").filter("c < 2 OR lang = 'de'").select("query_id", "id", "score")


@query(
    "r17_topic_dedupe",
    f"""WITH {LISTS}, n AS (SELECT a.*, d.source, coalesce(d.content, '') AS content FROM a JOIN docs d USING (id)), o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1), {_budget('o', 'g', 4, 4800)}
SELECT query_id, id, new_rank AS rank, length(content) AS chars FROM g""",
)
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lexical(spark, sf_dir)
    n = a.join(documents(spark, sf_dir).select("id", "source", "content"), "id")
    first = n.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))).filter("__n = 1").drop("__n")
    return R.within_budget(first, ["query_id"], 4, 4800).select("query_id", "id", "rank", F.length("content").cast("long").alias("chars"))


@query("r12_coverage", f"WITH q AS (SELECT item_id, list_distinct({_tok('text')}) AS qt FROM benchmark), d AS (SELECT conv_id, turn, list_distinct({_tok('text')}) AS w FROM conversations) SELECT item_id, conv_id, turn, floor(least(1.0, len(list_intersect(qt, w)) / len(qt)) * 1e6 + 0.5) / 1e6 AS coverage FROM q, d WHERE len(qt) > 0 AND len(list_intersect(qt, w)) > 0")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each item by each turn, by a join on the terms, so that pairs without a common term are never made."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("qt"))
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    terms = q.select("item_id", F.size("qt").alias("n"), F.explode("qt").alias("term"))
    return d.join(terms, "term").groupBy("item_id", "conv_id", "turn", "n").agg(F.count("*").alias("m")).select("item_id", "conv_id", "turn", R.rounded(F.least(F.lit(1.0), F.col("m") / F.col("n"))).alias("coverage"))


@query("r11_tokens", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return d.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("r9_rerank_terms", "SELECT item_id, array_to_string(list_sort(" + _RTOK.format("text") + "), ' ') AS terms FROM benchmark")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.rerank_tokens(F.col("text"))), " ").alias("terms"))


@query("r19_full_context", f"WITH {SEEN}, t AS (SELECT coalesce(sum(length(content)), 0) AS chars FROM seen) SELECT id, length(content) AS chars, CAST(1.0 AS DOUBLE) AS score FROM seen, t WHERE t.chars <= 8000000000")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.full_context(_visible(spark, sf_dir), 8_000_000_000)
    return docs.select("id", F.length("content").cast("long").alias("chars"), "score")
