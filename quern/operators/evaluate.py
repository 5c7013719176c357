"""Retrieval quality: hit rate, recall, precision, reciprocal rank and nDCG, and strategy comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = [1, 3, 5, 10]


def per_question(judged: DataFrame, ks: list[int] = KS) -> DataFrame:
    """question_id, k and metrics; judged has question_id, expected and retrieved (arrays of ids, best first).

    Questions without expected ids aren't judged. The reciprocal rank looks at the whole list, whatever k is;
    truncated_rr at the first k.
    """
    rows = judged.filter(F.size("expected") > 0).withColumn("expected", F.array_distinct("expected"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    top = F.slice("retrieved", 1, F.col("k"))
    found = F.size(F.array_intersect(top, F.col("expected")))
    flags = F.transform("retrieved", lambda x: F.array_contains(F.col("expected"), x).cast("int"))
    first = F.array_position(flags, 1)
    gain = F.aggregate(F.transform(F.slice(flags, 1, F.col("k")), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("k"), F.size("expected"))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    rr = F.when(first > 0, 1.0 / first).otherwise(0.0)
    return rows.select(
        "question_id",
        "k",
        (found > 0).cast("double").alias("hit"),
        (found / F.size("expected")).alias("recall"),
        (found / F.greatest(F.lit(1), F.size(top))).alias("precision"),
        rr.alias("rr"),
        F.when(first <= F.col("k"), rr).otherwise(0.0).alias("truncated_rr"),
        (gain / ideal).alias("ndcg"),
    )


def means(metrics: DataFrame, round_: Column | None = None) -> DataFrame:
    names = ["hit", "recall", "precision", "rr", "truncated_rr", "ndcg"]
    return metrics.groupBy("k").agg(F.count("*").alias("questions"), *((F.floor(F.avg(c) * 1e6 + 0.5) / 1e6).alias(c) for c in names))


def quotas(counts: DataFrame, total: int, by: str) -> DataFrame:
    """An even share of `total` for each group in name order, the first ones one more; no more than the group has."""
    w = Window.orderBy(by)
    named = counts.withColumn("i", F.row_number().over(w) - 1).crossJoin(F.broadcast(counts.agg(F.count("*").alias("groups"))))
    share = F.floor(F.lit(total) / F.col("groups")) + F.when(F.col("i") < F.lit(total) % F.col("groups"), 1).otherwise(0)
    return named.select(by, F.least(share, F.col("n")).cast("long").alias("quota"))


def stratified(rows: DataFrame, total: int, by: str, order: str) -> DataFrame:
    """The first rows of each group, as many as its quota."""
    q = quotas(rows.groupBy(by).agg(F.count("*").alias("n")), total, by)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return placed.join(q, by).filter(F.col("place") <= F.col("quota"))


def backends(predictions: DataFrame, expected: str) -> DataFrame:
    """By strategy: the lexical backends that answered, and whether the expected one alone did."""
    out = predictions.groupBy("strategy").agg(F.array_sort(F.collect_set("backend")).alias("seen"))
    return out.select("strategy", F.array_join("seen", ",").alias("backends"), (F.col("seen") == F.array(F.lit(expected))).alias("ok"))


def outside_scores(predictions: DataFrame, names: tuple[str, ...] = ("Faithfulness", "ContextPrecision", "ContextRecall", "ResponseRelevancy"), most: int = 10_000) -> DataFrame:
    """status, reason and scores (a map) of an outside judge's metrics over predictions (question, ground_truth, answer, contexts).

    The judge is an optional package that calls models, on the driver: at most `most` predictions, more are an error. Where it
    isn't installed or fails, the one row says NOT_EXECUTED and the error's kind.
    """
    spark = predictions.sparkSession
    try:
        import ragas
        import ragas.metrics
        from datasets import Dataset

        rows = predictions.limit(most + 1).collect()
        if not 0 < len(rows) <= most:
            raise ValueError("no predictions, or too many for one call")
        found = ragas.evaluate(Dataset.from_list([r.asDict() for r in rows]), metrics=[getattr(ragas.metrics, n)() for n in names])
        row = ("executed", None, {k: float(v) for k, v in dict(found).items()})
    except Exception as e:
        row = ("NOT_EXECUTED", type(e).__name__, {})
    return spark.createDataFrame([row], "status string, reason string, scores map<string,double>")
