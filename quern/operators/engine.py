"""A question's way through retrieval: the strategies with their fallbacks, in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import retrieval as R

STRATEGIES = ("VECTOR", "KEYWORD", "HYBRID", "HYBRID_RERANK")


def parse_strategy(name: str | None, fallback: str = "HYBRID_RERANK") -> str:
    name = (name or "").strip().upper()
    return name if name in STRATEGIES else fallback


@dataclass
class LexicalRouter:
    """The backend asked for, or another where it fails and the router may fall back; unknown names get full text."""

    backends: dict[str, Callable[[], DataFrame]]
    wanted: str = "FTS"
    fail_open: bool = True

    def hits(self) -> tuple[DataFrame, str, str | None]:
        """hits, the backend that gave them, and why it isn't the one asked for."""
        name = self.wanted if self.wanted in self.backends else "FTS"
        try:
            return self.backends[name](), name, None
        except Exception as e:
            if not self.fail_open or name == "FTS":
                raise
            return self.backends["FTS"](), "FTS", f"{name}_{type(e).__name__.upper()}"


@dataclass
class Result:
    hits: DataFrame | None
    strategy: str
    fallback: str | None
    backend: str | None = None
    failed: dict[str, str] = field(default_factory=dict)


def retrieve(strategy: str, vector: Callable[[], DataFrame], lexical: LexicalRouter, rerank: Callable[[DataFrame], DataFrame], final_k: int = 5, by: list[str] | None = None) -> Result:
    """Ranked hits of a strategy. A side that fails is left out; where both fail there are no hits, only evidence of it."""
    by = by or ["query_id"]
    failed: dict[str, str] = {}
    v = a = backend = reason = None
    if strategy != "KEYWORD":
        try:
            v = vector()
        except Exception as e:
            failed["vector"] = str(e)
    if strategy != "VECTOR" or v is None:
        try:
            a, backend, reason = lexical.hits()
        except Exception as e:
            failed["lexical"] = str(e)
    hits = R.rrf([x for x in (v, a)], 3 * final_k, by=by) if v is not None and a is not None else v if v is not None else a
    if strategy == "HYBRID_RERANK" and hits is not None:
        try:
            hits = rerank(hits)
        except Exception as e:
            failed["rerank"] = str(e)
    code = "EVIDENCE_ONLY" if hits is None else "FTS_ONLY" if "vector" in failed else "VECTOR_ONLY" if "lexical" in failed else "RRF" if "rerank" in failed else None
    return Result(hits, strategy, ",".join(filter(None, [code, reason])) or None, backend, failed)


def needs_second_pass(hits: int, question: str, enabled: bool = True, least_hits: int = 3, long: int = 180) -> bool:
    return enabled and (hits < least_hits or len(question) >= long)


def answer_frames(sources: DataFrame, parts: DataFrame, totals: DataFrame, by: str = "query_id") -> DataFrame:
    """by, place, kind and payload of an answer's frames in the order in which they are sent: its sources first, then its text
    part by part, its metrics last. sources and totals have one payload an answer, parts a payload and n for each part."""
    kinds = [("sources", sources.withColumn("n", F.lit(0))), ("text", parts), ("metrics", totals.withColumn("n", F.lit(0)))]
    tagged = [df.select(by, F.lit(i).alias("o"), F.col("n").cast("long").alias("n"), F.lit(kind).alias("kind"), "payload") for i, (kind, df) in enumerate(kinds)]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return every.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("o", "n"))).select(by, "place", "kind", "payload")


def metrics(result: DataFrame) -> DataFrame:
    """One row about retrieval timings: llm_ms is what the stages leave of the total, not below 0."""
    rest = F.col("total_ms") - F.col("vector_ms") - F.col("lexical_ms") - F.col("rrf_ms") - F.col("rerank_ms")
    bm25 = F.contains(F.col("lexical_backend"), F.lit("BM25"))
    return result.select(
        "*",
        F.greatest(F.lit(0), rest).alias("llm_ms"),
        F.when(bm25, F.col("lexical_ms")).otherwise(0).alias("bm25_query_latency_ms"),
        F.coalesce(F.contains(F.col("fallback"), F.lit("BM25")), F.lit(False)).alias("bm25_fallback"),
    )
