"""Ranked retrieval: vectors, BM25, boolean full text, fusion, re-ranking and budgets.

A ranked list is a DataFrame with `rank` from 1 within each query; row order never matters. Scores that two engines must
order alike are rounded before they are compared, and ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import rerank_tokens, tokens
from quern.operators.index import LexicalIndex, best_vectors

RRF_K = 60
PLACES = 6


def rounded(c: Column, places: int = PLACES) -> Column:
    s = 10.0**places
    return F.floor(c * s + 0.5) / s


def ranked(df: DataFrame, by: list[str], score: str, id_col: str, k: int | None = None) -> DataFrame:
    """rank by score, largest first, then by id; the k first of each `by` group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    out = df.withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(id_col))))
    return out if k is None else out.filter(F.col("rank") <= k)


def topk(df: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    """One list's k first: a distributed top-k, then ranks over k rows."""
    return ranked(df.orderBy(F.col(score).desc(), F.col(id_col)).limit(k), [], score, id_col)


# ---------------------------------------------------------------- vectors


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def vector_topk(vectors: DataFrame, query: list[float], k: int = 12, threshold: float = 0.2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cosine top-k for one query vector: exact, a distributed top-k, no sort of the table."""
    if not query:
        raise ValueError("an empty vector can't be searched for")
    q = F.array(*(F.lit(float(x)) for x in query))
    v = doubles(F.col(vector_col))
    length = sum(x * x for x in map(float, query)) ** 0.5
    scored = vectors.filter(F.col(vector_col).isNotNull()).select(id_col, rounded(dot(v, q) / (norm(v) * F.lit(length))).alias("score"))
    return topk(scored.filter(F.col("score") >= threshold), "score", id_col, k)


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 12, threshold: float = 0.2, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096) -> DataFrame:
    """query_id, id, score and rank for each query vector against all vectors, in blocks of matrix products.

    Queries are broadcast in blocks of `query_block`, or as many as MOST_VECTOR_BYTES hold; each task keeps its k best of
    each query before the shuffle, so a shuffle row is one of a task's best, not a pair. No queries give no rows.
    """
    return ranked(best_vectors(vectors, queries, k, threshold, id_col, vector_col, query_block), ["query_id"], "score", "id", k)


# ---------------------------------------------------------------- lexical


def bm25_scores(index: LexicalIndex, queries: DataFrame, text_col: str, query_id: str) -> DataFrame:
    """query_id, id and score for every document with a term of the query; query terms count once. For what needs all scores,
    such as their largest; a ranked list is what bm25_topk is for.

    The query terms are joined to the postings by term. A document's parts of a score are added up where they are made
    before they are shuffled.
    """
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    known = terms.join(index.terms, "term")
    part = index.weight(F.col("df"), F.col("tf"), F.col("dl"))
    return index.postings().join(known, "term").groupBy("query_id", "id").agg(rounded(F.sum(part)).alias("score"))


def bm25_topk(index: LexicalIndex, queries: DataFrame, text_col: str, query_id: str, k: int = 12, cap: int = 20) -> DataFrame:
    """Ranked lists of the k best documents of each query; a query without a known term has none."""
    k = min(max(1, k), cap)
    return ranked(index.best(queries, text_col, query_id, k), ["query_id"], "score", "id", k)


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (wanted, phrase): words are joined by and, `or` separates, - excludes, quotes make
    a phrase. Terms are lower-cased and neither stemmed nor stopped."""
    import re

    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not phrase and word.lower() == "or":
            out.append([])
            continue
        terms = re.findall(r"[^\W_]+", (phrase or word).lower())
        if terms:
            out[-1].append((not minus, terms))
    return [c for c in out if c]


def fts_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fts_match(words: Column, query: str) -> Column:
    """Whether an array of words satisfies the query. The array is bound once, however often the query looks at it."""

    def phrase(w: Column, terms: list[str]) -> Column:
        if len(terms) == 1:
            return F.array_contains(w, terms[0])
        want = F.array(*map(F.lit, terms))
        return F.exists(F.sequence(F.lit(1), F.greatest(F.size(w) - (len(terms) - 1), F.lit(1))), lambda i: F.slice(w, i, len(terms)) == want)

    parsed = parse_websearch(query)
    if not parsed:
        return F.lit(False)

    def holds(w: Column) -> Column:
        ways = [reduce(lambda a, b: a & b, [phrase(w, t) if wanted else ~phrase(w, t) for wanted, t in way]) for way in parsed]
        return reduce(lambda a, b: a | b, ways)

    return F.exists(F.array(words), holds)


def fts_topk(docs: DataFrame, query: str, id_col: str, words_col: str, k: int = 12) -> DataFrame:
    """docs has each document's words, see fts_words. Matches ordered by the density of the query's words: occurrences over the logarithm of the length."""
    terms = sorted({t for way in parse_websearch(query) for wanted, ts in way if wanted for t in ts})
    words = docs.select(F.col(id_col).alias("id"), F.col(words_col).alias("w")).filter(fts_match(F.col("w"), query))
    hits = F.size(F.filter("w", lambda w: w.isin(terms))) if terms else F.lit(0)
    return topk(words.select("id", rounded(hits / (1.0 + F.log(F.size("w") + 1.0))).alias("score")), "score", "id", k)


# ---------------------------------------------------------------- fusion and re-ranking


def rrf(lists: list[DataFrame], n: int, k: int = RRF_K, by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists; the payload comes from the first list that has the id. Empty for k or n below 1."""
    by = by or []
    tagged = [x.withColumn("list_no", F.lit(i)) for i, x in enumerate(lists)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if k < 1 or n < 1:
        both = both.filter("false")
    payload = [c for c in both.columns if c not in {*by, id_col, "rank", "score", "list_no"}]
    fused = both.groupBy(*by, id_col).agg(rounded(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"), *(F.min_by(c, "list_no").alias(c) for c in payload))
    return ranked(fused, by, "score", id_col, n)


def heuristic_rerank(hits: DataFrame, query: Column, by: list[str], id_col: str = "id", content: str = "content", title: str = "title", most: int = 30, most_chars: int = 1600) -> DataFrame:
    """0.55 * share of query terms in the content + 0.20 * in the title + 0.10 if the query itself occurs + 0.15 / old rank.

    The first `most` hits are re-ranked; the others follow in their old order with score 0.
    """
    text = F.substring(F.coalesce(F.col(content), F.lit("")), 1, most_chars)
    q = rerank_tokens(query)
    share = lambda c: F.when(F.size("__q") > 0, F.size(F.array_intersect(F.col("__q"), rerank_tokens(c))) / F.size("__q")).otherwise(0.0)
    exact = F.when((F.trim(query) != "") & F.contains(F.lower(text), F.lower(F.trim(query))), 0.10).otherwise(0.0)
    df = hits.withColumn("__q", q)
    scored = 0.55 * share(text) + 0.20 * share(F.col(title)) + exact + 0.15 / F.col("rank")
    df = df.withColumn("__old", F.col("rank")).withColumn("score", F.when(F.col("__old") <= most, rounded(scored)).otherwise(0.0))
    w = Window.partitionBy(*by).orderBy(F.when(F.col("__old") <= most, 0).otherwise(F.col("__old")), F.col("score").desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(w)).drop("__q", "__old")


def merge_order(hits: DataFrame, order: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """Apply an outside order (id, position) to hits: unknown ids are dropped, repeats count once, missing hits follow."""
    first = order.groupBy(*by, id_col).agg(F.min("position").alias("position"))
    w = Window.partitionBy(*by).orderBy(F.col("position").asc_nulls_last(), "rank", id_col)
    return hits.join(first, [*by, id_col], "left").withColumn("new_rank", F.row_number().over(w)).drop("rank", "position").withColumnRenamed("new_rank", "rank")


def within_budget(hits: DataFrame, by: list[str], k: int = 5, chars: int = 9000, content: str = "content") -> DataFrame:
    """Walk the hits in rank order until k hits or `chars` characters; the last is cut, blank ones take no place."""
    filled = hits.filter(F.trim(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"[\x00-\x20]", " ")) != "")
    before = F.coalesce(F.sum(F.length(content)).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = filled.withColumn("__before", before).filter(F.col("__before") < chars)
    cut = cut.withColumn(content, F.expr(f"substring({content}, 1, cast({chars} - __before as int))")).filter(F.trim(content) != "")
    w = Window.partitionBy(*by).orderBy("rank")
    return cut.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).withColumn("rank", F.col("__rank")).drop("__rank", "__before")


def full_context(docs: DataFrame, most_chars: int, content: str = "content") -> DataFrame:
    """All documents with score 1 where they have at most `most_chars` characters together, else none: the choice is one
    scalar, made in the plan."""
    total = docs.agg(F.coalesce(F.sum(F.length(content)), F.lit(0)).alias("__total"))
    return docs.crossJoin(F.broadcast(total)).filter(F.col("__total") <= most_chars).drop("__total").withColumn("score", F.lit(1.0))


def fallback_code(vector_failed: Column, lexical_failed: Column, rerank_failed: Column, reason: Column) -> Column:
    """What a result fell back to, with the lexical backend's own reason after a comma; null if nothing failed."""
    code = F.when(vector_failed & lexical_failed, "EVIDENCE_ONLY").when(vector_failed, "FTS_ONLY").when(lexical_failed, "VECTOR_ONLY").when(rerank_failed, "RRF")
    joined = F.concat_ws(",", code, F.when(F.trim(F.coalesce(reason, F.lit(""))) != "", reason))
    return F.when(joined != "", joined)


def clean_rewrites(df: DataFrame, original: Column, rewrites: str, most: int = 2) -> Column:
    """Trimmed rewrites that aren't blank, repeated, or the question itself in other letter case; `most` at most."""
    trimmed = F.array_distinct(F.transform(F.col(rewrites), lambda r: F.trim(r)))
    return F.slice(F.filter(trimmed, lambda r: (r != "") & (F.lower(r) != F.lower(F.trim(original)))), 1, most)
