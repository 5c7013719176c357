"""A written lexical index, and top-k lists that tasks keep while they score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.sources.tables import written

K1, B = 1.2, 0.75
#: Queries, and their terms together, of one broadcast.
MOST_QUERIES, MOST_TERMS = 1024, 500_000
#: Bytes of a block of query vectors.
MOST_VECTOR_BYTES = 64_000_000
SLICE = 512


class BestOf:
    """The k best (score, then smaller id) of each query among all rows seen. Only rows that reach a query's k-th best so far,
    or of their own slice, are sorted."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), None

    def add(self, ids: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> None:
        """scores has a row for each query and a column for each id; wanted says which of them count."""
        scores = np.where(wanted, scores, -np.inf)
        floor = self.floor
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        query, column = np.nonzero((scores >= floor[:, None]) & wanted)
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, scores[query, column]])
        found = ids[column] if self.id is None else np.concatenate([self.id, ids[column]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.id = query[keep], score[keep], found[keep]
        last = np.flatnonzero(np.bincount(self.query, minlength=len(self.floor)) == self.k)
        self.floor[last] = self.score[np.searchsorted(self.query, last, "right") - 1]

    def batches(self, names: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.id is not None:
            columns = ([names[q] for q in self.query.tolist()], self.id.tolist(), self.score.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _arrow(name: str, kind: str) -> pa.Field:
    return pa.field(name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])


Scores = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def best_rows(rows: DataFrame, names: list, query_type: str, k: int, scored: Callable[[Iterator[pa.RecordBatch]], Scores], kind: str) -> DataFrame:
    """query_id, id and score of each task's k best rows of every query; scored gives ids, scores and which count, a slice at a
    time."""
    schema = pa.schema([_arrow("query_id", query_type), _arrow("id", kind), pa.field("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestOf(len(names), k)
        for ids, scores, wanted in scored(batches):
            best.add(ids, scores, wanted)
        yield from best.batches(names, schema)

    return rows.mapInArrow(run, f"query_id {query_type}, id {kind}, score double")


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, cut where key changes, so that rows of one key that follow each other stay together."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None:
        yield rest


def rounded_up(scores: np.ndarray, places: int = 6) -> np.ndarray:
    return np.floor(scores * 10**places + 0.5) / 10**places


def empty_hits(queries: DataFrame, query_id: str, id_type: str) -> DataFrame:
    kind = queries.schema[query_id].dataType.simpleString()
    return queries.sparkSession.createDataFrame([], f"query_id {kind}, id {id_type}, score double")


def counted(words: Column) -> Column:
    """dl, terms and tfs of a list of words: its length, the different ones in order, and how often each occurs. An expression,
    so a document never waits in a batch with others."""

    def runs(s: Column) -> Column:
        first = F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i))
        return F.struct(s.alias("s"), F.filter(first, lambda i: i.isNotNull()).alias("first"))

    def each(r: Column) -> Column:
        s, first = r["s"], r["first"]
        tfs = F.transform(first, lambda i, n: (F.coalesce(F.get(first, n + 1), F.size(s)) - i).cast("long"))
        return F.struct(F.size(s).cast("long").alias("dl"), F.transform(first, lambda i: F.get(s, i)).alias("terms"), tfs.alias("tfs"))

    # a list of one binds what is looked at several times
    return F.get(F.transform(F.transform(F.array(F.sort_array(words)), runs), each), F.lit(0))


class LexicalIndex:
    """Documents with their terms and frequencies, and each term's number of documents: two tables, written once.

    Scores are made where the documents are, a slice at a time against a block of queries, and a task hands on its k best
    of each query; so no row is ever a pair of a query and a document that isn't among them. Of a document only the terms that
    a query asks for go to Python, one a row, so that a batch is small whatever the documents are like.
    """

    def __init__(self, docs: DataFrame, id_col: str, text: Column):
        listed = docs.select(F.col(id_col).alias("id"), counted(tokens(text)).alias("x"))
        self.docs = written(listed.select(F.monotonically_increasing_id().alias("doc"), "id", "x.dl", "x.terms", "x.tfs"), "index")
        self.terms = written(self.docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
        row = self.docs.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("dl")).alias("l")).first()
        self.n_docs, self.avg_len = row["n"], row["l"] or 1.0

    def postings(self) -> DataFrame:
        """term, id, tf and dl."""
        each = self.docs.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        return each.select(F.col("x.terms").alias("term"), "id", F.col("x.tfs").alias("tf"), "dl")

    def weight(self, df: Column, tf: Column, dl: Column) -> Column:
        idf = F.log(1.0 + (self.n_docs - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / F.lit(self.avg_len)))

    def best(self, queries: DataFrame, text_col: str, query_id: str, k: int) -> DataFrame:
        """query_id, id and score: each task's k best of every query. Query terms count once; ids of queries aren't repeated."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
        known = written(asked.join(self.terms, "term"), "asked")
        size = known.agg(F.countDistinct("query_id"), F.count("*")).first()
        blocks = max(-(-size[0] // MOST_QUERIES), -(-size[1] // MOST_TERMS))
        kind = queries.schema[query_id].dataType.simpleString()
        out = empty_hits(queries, query_id, self.docs.schema["id"].dataType.simpleString())
        for b in range(blocks):
            rows = known.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            if rows:
                out = out.unionByName(self._best(rows, kind, k))
        return out

    def _best(self, rows: list, query_type: str, k: int) -> DataFrame:
        names = sorted({r["query_id"] for r in rows})
        place = {q: i for i, q in enumerate(names)}
        rows.sort(key=lambda r: r["term"])
        vocabulary = sorted({r["term"] for r in rows})
        at = np.searchsorted(np.array(vocabulary), [r["term"] for r in rows])
        df = np.zeros(len(vocabulary))
        df[at] = [r["df"] for r in rows]
        idf = np.log(1.0 + (self.n_docs - df + 0.5) / (df + 0.5))
        askers, ends = np.array([place[r["query_id"]] for r in rows]), np.cumsum(np.bincount(at, minlength=len(vocabulary)))
        spark = self.docs.sparkSession
        held = spark.sparkContext.broadcast((idf, askers, ends, self.avg_len, len(names)))
        known = spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string()), "place": pa.array(range(len(vocabulary)), pa.int64())}))
        each = self.docs.select("doc", "id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        each = each.select("doc", "id", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
        asked = each.join(F.broadcast(known), "term").select("doc", "id", "dl", "tf", "place")  # a document's rows stay neighbours

        def scored(batches: Iterator[pa.RecordBatch]) -> Scores:
            idf, askers, ends, avg_len, n = held.value
            starts = np.concatenate([[0], ends])
            for batch in whole(batches, "doc"):
                begins = np.flatnonzero(np.diff(batch.column("doc").to_numpy(zero_copy_only=False), prepend=-1))
                for i in range(0, len(begins), SLICE):
                    at = begins[i : i + SLICE]
                    end = begins[i + SLICE] if i + SLICE < len(begins) else batch.num_rows
                    part = batch.slice(at[0], end - at[0])
                    doc = np.repeat(np.arange(len(at)), np.diff(np.append(at, end)))
                    term, tf, dl = (part.column(c).to_numpy(zero_copy_only=False) for c in ("place", "tf", "dl"))
                    weight = idf[term] * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avg_len))
                    first = starts[term]
                    times = ends[term] - first
                    each = np.repeat(np.arange(len(term)), times)
                    asker = askers[np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + first[each]]
                    scores = rounded_up(np.bincount(asker * len(at) + doc[each], weight[each], n * len(at)).reshape(n, len(at)))
                    yield np.array(batch.column("id").take(pa.array(at)).to_pylist()), scores, scores > 0

        return best_rows(asked, names, query_type, k, scored, self.docs.schema["id"].dataType.simpleString())


def best_vectors(vectors: DataFrame, queries: DataFrame, k: int, threshold: float, id_col: str, vector_col: str, query_block: int) -> DataFrame:
    """query_id, id and score: each task's k best of every query vector, by cosine. Blocks of queries are bounded in bytes."""
    asked = queries.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v")).dropDuplicates(["query_id"])
    size = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = size[1] or 1
    blocks = -(-size[0] // max(1, min(query_block, MOST_VECTOR_BYTES // (8 * width))))
    kind, own = queries.schema[id_col].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    rows = vectors.filter(F.size(vector_col) == width).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    out = empty_hits(asked, "query_id", own)
    for b in range(blocks):
        found = asked.filter((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) & (F.size("v") == width)).collect()
        if not found:
            continue
        q = np.array([r["v"] for r in found], np.float64)
        held = vectors.sparkSession.sparkContext.broadcast(q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))

        def scored(batches: Iterator[pa.RecordBatch], held=held) -> Scores:
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    scores = rounded_up(held.value @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T)
                    yield np.array(part.column("id").to_pylist()), scores, scores >= threshold

        out = out.unionByName(best_rows(rows, [r["query_id"] for r in found], kind, k, scored, own))
    return out
