"""Quality scores by nearest-neighbour voting over latent-semantic vectors of a text's terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, back, byte_column, ids, sliced, text_of, written
from quern.llm.language import fold

#: Labelled documents that are fitted on and vote, at most; the least hashes of their ids.
MOST_LABELLED = 6000
#: Terms of all labelled documents together, at most: where they are longer, fewer of them are fitted on.
MOST_TERMS = 4_000_000
#: Hashed places of the three kinds of terms: words as they are written, runs of character classes, and how often words and
#: lines come again, how long words are and how long the text is.
WORDS, SHAPES, REPEATS = 1 << 15, 1 << 12, 64
KINDS = [(0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, WORDS + SHAPES + REPEATS)]
PLACES = WORDS + SHAPES + REPEATS
LATENT = 64
NEIGHBOURS = 16
#: Votes weigh the cosine to this power.
POWER = 8

_CLASS = np.zeros(256, np.uint32)
_CLASS[128:] = 1
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 5 if _c == "\n" else 6 if _c.isspace() or _i < 32 else 7 + _i


def _classes(counts: list[int]) -> np.ndarray:
    """How many of all occurrences belong to things that come once, twice or three times, four to seven times and so on."""
    n = np.array(counts, np.float64)
    return np.bincount(np.minimum(15, np.log2(n)).astype(np.int64), n, 16) if len(n) else np.zeros(16)


def features(raw: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the text's terms: its distinct words, then shapes, then repeats. Words that share a place are apart."""
    words = Counter(raw.split())
    at = (hashes.of(list(words)) % np.uint64(WORDS)).astype(np.int64)
    count = np.fromiter(words.values(), np.float64, len(words))
    shapes = np.zeros(SHAPES)
    codes = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(codes):
        codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])]  # a run of one class counts once
        two = codes[:-1] * np.uint32(211) + codes[1:]
        three = two[:-1] * np.uint32(211) + codes[2:]
        four = three[:-1] * np.uint32(211) + codes[3:]
        found = np.concatenate([two + np.uint32(7), three + np.uint32(70001), four]) * np.uint32(0x9E3779B1) >> np.uint32(20)
        shapes = np.bincount(found, minlength=SHAPES)
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    lengths = np.bincount(np.minimum(15, np.fromiter(map(len, words), np.int64, len(words))), count, 16)
    size = np.zeros(16)
    size[min(15, int(np.log2(count.sum() + 1)))] = 1 + count.sum()
    again = np.concatenate([_classes(list(words.values())), _classes(list(lines.values())), lengths, size])
    rest = np.concatenate([shapes, again])
    there = np.flatnonzero(rest)
    return np.concatenate([at, WORDS + there]), np.concatenate([count, rest[there]]).astype(np.float32)


class Rows:
    """Sparse rows, with products by dense matrices that never hold more than some entries' worth of them at once."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows
        at = np.concatenate([np.empty(0, np.int32), *(a for a, _ in rows)], dtype=np.int32)
        by = np.argsort(at, kind="stable")
        self.at = at[by]
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) for a, _ in rows])[by]
        self.value = np.concatenate([np.empty(0, np.float32), *(v for _, v in rows)], dtype=np.float32)[by]

    def times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.rows), m.shape[1]), np.float32)
        for o, (at, value) in zip(out, self.rows, strict=True):
            np.dot(value, m[at], out=o)
        return out

    def transposed_times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((PLACES, m.shape[1]), np.float32)
        for i in range(0, len(self.at), 50_000):
            at = self.at[i : i + 50_000]
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out[at[new]] += np.add.reduceat(m[self.row[i : i + 50_000]] * self.value[i : i + 50_000, None], new, axis=0)
        return out


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' space by its small Gram matrix; directions without weight are left out."""
    w, v = np.linalg.eigh((y.T @ y).astype(np.float64))
    keep = w > 1e-6 * max(float(w[-1]), 1e-30)
    return y @ (v[:, keep] / np.sqrt(w[keep])).astype(np.float32)


class Model:
    """A projection to latent-semantic space with the labelled documents' vectors in it."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        n = len(counts)
        seen = np.bincount(np.concatenate([np.empty(0, np.int32), *(a for a, _ in counts)]), minlength=PLACES)
        self.idf = (np.log((n + 1) / (1 + seen)) + 0.05).astype(np.float32)
        self.to_latent = np.zeros((PLACES, LATENT), np.float32)
        if n:
            x = Rows([self.weigh(*c) for c in counts])
            y = x.times(np.random.default_rng(7).standard_normal((PLACES, LATENT + 16)).astype(np.float32))
            for _ in range(2):  # subspace iteration towards the leading singular vectors
                z = _orthonormal(x.transposed_times(_orthonormal(y)))
                y = x.times(z)
            _, v = np.linalg.eigh((y.T @ y).astype(np.float64))
            found = z @ v[:, ::-1][:, :LATENT].astype(np.float32)
            self.to_latent[:, : found.shape[1]] = found
        self.vectors = self.project(counts)

    def weigh(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of a text's terms: log(1 + count) times the inverse document frequency; each kind has length 1."""
        w = np.log1p(n) * self.idf[at]
        ends = [np.count_nonzero(at < high) for _, high in KINDS]
        for part in map(slice, [0, *ends], ends):
            w[part] /= max(float(np.linalg.norm(w[part])), 1e-9)
        return at, w

    def project(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        v = np.zeros((len(counts), LATENT), np.float32)
        for out, c in zip(v, counts, strict=True):
            at, w = self.weigh(*c)
            np.dot(w, self.to_latent[at], out=out)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The nearest neighbours' labels, weighted by similarity; cosines with all labelled vectors, in blocks."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = []
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(counts), 256):
            near = self.project(counts[i : i + 256]) @ self.vectors.T
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** POWER + 1e-12
            out.append((w * self.labels[at]).sum(axis=1) / w.sum(axis=1))
        return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, most: int) -> Model:
    """Fit on at most `most` labelled documents with MOST_TERMS terms together, those with the least hashes of their ids. Of an
    id with several texts the one whose terms sort first counts. So what the driver gets is bounded in rows and in bytes."""
    marked = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL AND id IS NOT NULL")
    chosen = marked.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            x = [features(raw, hashes) for raw in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array([a.astype("<i4").tobytes() for a, _ in x], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in x], pa.binary())],
                names=["id", "y", "at", "n"],
            )

    found = texts.join(F.broadcast(chosen), "id").mapInArrow(run, "id long, y int, at binary, n binary")
    one = written(found.groupBy("id").agg(F.min(F.struct("at", "n", "y")).alias("x")).select(F.xxhash64("id").alias("h"), "id", "x.*"), "labelled")
    sizes = sorted(one.select("h", (F.octet_length("at") / 4).alias("terms")).collect())  # `most` small rows at most
    fit = int(np.searchsorted(np.cumsum([r["terms"] for r in sizes]), MOST_TERMS, "right"))
    rows = one.filter(F.col("h") <= sizes[max(1, fit) - 1]["h"]).collect() if sizes else []
    rows.sort(key=lambda r: r["id"])
    return Model([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<f4")) for r in rows], np.array([r["y"] for r in rows], np.float32))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", folds: int = 5, held_out: int = 0, threshold: float = 0.3, most: int = MOST_LABELLED
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels outside the held-out fold are learned from, at most `most` of them and MOST_TERMS terms together; a document with several counts with the
    largest. Null and empty texts are scored as texts without words. Without labels every score is 0.5. Documents with a
    null id are scored and not held out. Rows that repeat an id are scored each. Other columns aren't looked at. An empty
    table gives no rows. What is broadcast are PLACES * LATENT weights (9 MB) and `most` vectors.
    """
    model = train(docs, labels.filter(fold(label_id, folds) != held_out), id_col, text_col, label_id, label_col, most)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, 256):
            scores = held.value.score([features(x, hashes) for x in byte_column(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(ids(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(run, "id long, score double").withColumn("doc_id", back("id"))
    return out.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
