"""What an outside service would provide, with deterministic stand-ins: embeddings, token counts, contexts, re-rankers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class TokenCounter(Protocol):
    def __call__(self, text: str) -> int: ...


class Reranker(Protocol):
    def order(self, question: str, texts: list[str]) -> list[int]: ...


class QueryRewriter(Protocol):
    def rewrite(self, question: str) -> list[str]: ...


class HashEmbedder:
    """Signed hashes of the words, of length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for v, t in zip(out, texts, strict=True):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % self.dimension] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def with_retries(call: Callable, attempts: int = 5, wait: float = 0.5) -> Callable:
    """The call, tried again with waits that double; the last error goes on."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(wait * 2**k)

    return run


def embed(rows: DataFrame, id_col: str, text_col: str, embedder: Embedder | None = None, batch: int = 10) -> DataFrame:
    """id and embedding, `batch` texts a call; a result of the wrong shape is an error."""
    used = embedder or HashEmbedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(used.embed)
        for pdf in batches:
            parts = []
            for i in range(0, len(pdf), batch):
                got = call(pdf["text"].iloc[i : i + batch].tolist())
                if got.shape != (len(pdf.iloc[i : i + batch]), used.dimension):
                    raise ValueError(f"embeddings of shape {got.shape}")
                parts += got.astype(np.float32).tolist()
            yield pd.DataFrame({"id": pdf["id"], "embedding": parts})

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, embedding array<float>")


class VectorStore(Protocol):
    def add(self, ids: list, texts: list[str]) -> None: ...


def add_to_store(rows: DataFrame, id_col: str, text_col: str, store: Callable[[], VectorStore], batch: int = 10) -> DataFrame:
    """id and size of the call that stored it: each task opens the store and adds its rows, `batch` a call at most. A call is
    tried again where it fails, so a store must take an id that it has as an update."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        add = with_retries(store().add)
        for pdf in batches:
            sizes = []
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                add(part["id"].tolist(), part["text"].tolist())
                sizes += [len(part)] * len(part)
            yield pd.DataFrame({"id": pdf["id"], "size": sizes})

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, size int")
