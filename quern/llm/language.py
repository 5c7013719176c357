"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods, languages chosen by penalty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import back, ids, keep_rows, sliced, text_column

#: Hashed n-grams of one, two and three letters share this many places.
PLACES = 1 << 15
SMOOTHING = 0.5
#: Share of the mixture below which a language isn't considered after the first round.
LEAST_SHARE = 0.03
#: A further language must raise the log likelihood by this times the logarithm of the number of n-grams. An n-gram model
#: sees each letter three times, so the usual half is taken three times.
PENALTY = 1.5
ROUNDS = 15
UNKNOWN = "und"
#: Languages of a model at most: it is broadcast, PLACES doubles (256 KB) for each.
MOST_LANGUAGES = 1000

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_SPACE = 32


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, other characters as one space for each run, a space at both ends; empty
    if there is no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _LETTER[np.minimum(raw, 0xFFFF)]
    if (high := raw > 0xFFFF).any():
        is_letter[high] = [chr(c).isalpha() for c in raw[high]]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    raw = np.concatenate([[_SPACE], np.where(is_letter, raw, _SPACE), [_SPACE]]).astype(np.uint32)
    keep = np.concatenate([[True], (raw[1:] != _SPACE) | (raw[:-1] != _SPACE)])
    return raw[keep]


def grams(text: str) -> np.ndarray:
    """Places of the text's n-grams, with repeats."""
    c = letters(text).astype(np.uint32)
    if not len(c):
        return np.empty(0, np.int64)
    one = c * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B)) ^ one[1:]
    three = (c[:-2] * np.uint32(0xC2B2AE35)) ^ (two[1:] * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - (PLACES - 1).bit_length())
    return (np.concatenate([one, two, three]) * np.uint32(0x2C1B3C6D) >> shift).astype(np.int64)


class Model:
    """Probabilities of the n-grams in each language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        p = counts.astype(np.float64) + SMOOTHING
        self.p = np.ascontiguousarray((p / p.sum(axis=1, keepdims=True)).T)

    def mixture(self, p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares after expectation-maximisation, and the log likelihood."""
        total = n.sum()
        for _ in range(ROUNDS):
            each = p @ share
            new = share * (p.T @ (n / each)) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def judge(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        """The leading language, its share, and all languages chosen with their shares."""
        found = grams(text)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0, []
        counts = np.bincount(found, minlength=PLACES)
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(np.float64), self.p[at]
        share, likelihood = self.mixture(p, n, np.full(len(self.names), 1 / len(self.names)))
        chosen = np.flatnonzero(share >= min(LEAST_SHARE, share.max()))
        if len(chosen) < len(share):
            share, likelihood = self.mixture(p[:, chosen], n, share[chosen] / share[chosen].sum())
        price = PENALTY * float(np.log(n.sum() + 1))
        while len(chosen) > 1:
            trials = []
            for k in range(len(chosen)):
                rest = np.delete(share, k)
                rest = rest / rest.sum() if rest.sum() > 0 else np.full(len(rest), 1 / len(rest))
                trials.append((*self.mixture(np.delete(p[:, chosen], k, axis=1), n, rest), k))
            best = max(trials, key=lambda x: x[1])
            if likelihood - best[1] > price:
                break
            share, likelihood, chosen = best[0], best[1], np.delete(chosen, best[2])
        order = np.argsort(-share, kind="stable")
        mix = [(self.names[chosen[k]], float(share[k])) for k in order]
        return mix[0][0], min(1.0, max(0.0, mix[0][1])), mix


_COUNTS = "lang string, counts binary"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("counts", pa.binary())])


def _rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], schema=_COUNTS_ARROW)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            got = np.frombuffer(raw, "<i8")
            sums[lang] = sums[lang] + got if lang in sums else got
    yield _rows(sums)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count n-grams by language over all given documents. A task hands on one array of PLACES counts for each language;
    the arrays are added up in two further steps, so no task gets more than a part of them at once. More than
    MOST_LANGUAGES names are an error: a column with that many holds something else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), text_column(batch, "text"), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(PLACES, np.int64)
                sums[lang] += np.bincount(grams(text), minlength=PLACES)
        part = TaskContext.get().partitionId()
        got = _rows(sums)
        yield pa.RecordBatch.from_arrays([*got.columns, pa.array([part] * len(sums), pa.int64())], names=["lang", "counts", "part"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    names = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if names > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would be too large to broadcast")
    parts = rows.mapInArrow(run, _COUNTS + ", part long")
    some = parts.repartition(32, "lang", F.col("part") % 16).mapInArrow(_add, _COUNTS)
    found = sorted(some.repartition(4, "lang").mapInArrow(_add, _COUNTS).collect(), key=lambda r: r["lang"])
    return Model([r["lang"] for r in found], np.array([np.frombuffer(r["counts"], "<i8") for r in found]).reshape(-1, PLACES))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, languages (names, largest share first) and shares, for each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in sliced(batches):
            got = [m.judge(t) for t in text_column(batch, "text")]
            mixes = [g[2] for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([[x for x, _ in m] for m in mixes], pa.list_(pa.string())),
                    pa.array([[x for _, x in m] for m in mixes], pa.list_(pa.float64())),
                ],
                names=["id", "lang_pred", "score", "languages", "shares"],
            )

    rows = docs.select(ids(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, languages array<string>, shares array<double>")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1).cast("long"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages, shares.

    Learned from the documents outside the held-out fold whose text and language aren't null. score is the share of
    lang_pred in the document's mixture. A null text, or one without a letter, is `und` with score 0, and so is every
    document where nothing could be learned. A document with a null id isn't held out. Other columns aren't looked at.
    An empty table gives no rows. The model is a table of PLACES probabilities for each language.
    """
    model = train(docs.filter(fold(id_col, folds) != held_out), text_col, lang_col)
    out = predict(docs, model, id_col, text_col).withColumn("doc_id", back("id"))
    return out.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score", "languages", "shares")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_share: float = 0.4) -> DataFrame:
    """The documents with a leading language of at least `least_share`, columns as they were.

    Learned as by identify. Each row is decided on by its own text: null ids and repeated ids make no difference, null texts
    and those without a letter go, and so does everything where nothing could be learned. An empty table gives no rows.
    """
    model = train(docs.filter(fold(id_col, 4) != 2), text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def wanted():
        def judge(texts: list[str]) -> list[bool]:
            found = (held.value.judge(t) for t in texts)
            return [name != UNKNOWN and share >= least_share for name, share, _ in found]

        return judge

    return keep_rows(docs, text_col, wanted)
