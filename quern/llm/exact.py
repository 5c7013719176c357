"""Exact deduplication by a cuckoo filter whose hits are verified against bucketed content."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import back, ids, sliced, text_column, text_of, written

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests with insertion, deletion and exact membership.

    A table of buckets of four 16-bit fingerprints answers most probes; each slot also names a stored key, so that a
    fingerprint's hit counts only if the stored digest is equal and, where the entry has content, if that is equal too:
    two contents of one digest are an error, never one group. When an insertion finds no place the number of buckets
    doubles and all live digests are placed anew from the stored keys. Deleted entries' places in the store are used
    again. Each digest carries a payload (the id that stays, the size of its group) and, if wanted, its content.
    """

    def __init__(self, buckets: int = 256):
        self.keys: list[bytes | None] = []
        self.kept: list[int] = []
        self.size: list[int] = []
        self.free: list[int] = []
        self.content: dict[int, str] = {}
        self.resizes = self.verified = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.n = buckets
        self.prints = np.zeros(buckets * SLOTS, np.uint16).tolist()
        self.entry = [-1] * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "big") or 1
        first = int.from_bytes(digest[:8], "big") & (self.n - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & (self.n - 1)

    def _slot(self, digest: bytes) -> int:
        print_, a, b = self._places(digest)
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == print_ and self.entry[slot] >= 0 and self.keys[self.entry[slot]] == digest:
                    return slot
        return -1

    def get(self, digest: bytes) -> tuple[int, int] | None:
        slot = self._slot(digest)
        return None if slot < 0 else (self.kept[self.entry[slot]], self.size[self.entry[slot]])

    def insert(self, digest: bytes, id_: int, count: int = 1, content: str | None = None) -> bool:
        """True if the digest is new; otherwise its group grows and keeps the larger id, if the contents are equal."""
        slot = self._slot(digest)
        if slot >= 0:
            e = self.entry[slot]
            if content is not None and e in self.content:
                if self.content[e] != content:
                    raise ValueError(f"two contents have the digest {digest.hex()}")
                self.verified += 1
            self.kept[e] = max(self.kept[e], id_)
            self.size[e] += count
            return False
        if self.free:
            e = self.free.pop()
            self.keys[e], self.kept[e], self.size[e] = digest, id_, count
        else:
            e = len(self.keys)
            self.keys.append(digest)
            self.kept.append(id_)
            self.size.append(count)
        if content is not None:
            self.content[e] = content
        while not self._place(digest, e):
            self._resize()
        return True

    def forget(self) -> None:
        """Drop the contents; the digests stay."""
        self.content.clear()

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        e = self.entry[slot]
        self.prints[slot], self.entry[slot] = 0, -1
        self.keys[e] = None
        self.content.pop(e, None)
        self.free.append(e)
        return True

    def _place(self, digest: bytes, e: int) -> bool:
        print_, a, b = self._places(digest)
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.entry[slot] < 0:
                    self.prints[slot], self.entry[slot] = print_, e
                    return True
        bucket, moved = b, []
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            moved.append((slot, self.prints[slot], self.entry[slot]))
            self.prints[slot], print_ = print_, self.prints[slot]
            self.entry[slot], e = e, self.entry[slot]
            bucket = self._other(bucket, print_)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.entry[slot] < 0:
                    self.prints[slot], self.entry[slot] = print_, e
                    return True
        for slot, old, entry in reversed(moved):
            self.prints[slot], self.entry[slot] = old, entry
        return False

    def _resize(self) -> None:
        buckets = self.n * 2
        while True:
            self._empty(buckets)
            self.resizes += 1
            if all(self._place(k, e) for e, k in enumerate(self.keys) if k is not None):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        for k, i, n in zip(self.keys, self.kept, self.size, strict=True):
            if k is not None:
                yield k, i, n


INDEX_SCHEMA = "digest binary, keep_id long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_MET = "digest binary, keep_id long, group_size long, text string"
_MET_ARROW = pa.schema([*_ARROW, ("text", pa.string())])
#: Contents that an input task holds at once, in characters, and live digests of any task.
MOST_CHARS, MOST_LIVE = 16_000_000, 200_000


def _batches(rows: list[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + most], strict=True), schema.types, strict=True)], schema=schema)


def _met(most_chars: int, most_live: int):
    """An input task's texts (digest, id, text), copies put together: each distinct text leaves once, with its content,
    whenever the task holds enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = CuckooIndex(), 0

        def rows() -> list[tuple]:
            return [(k, index.kept[e], index.size[e], index.content[e]) for e, k in enumerate(index.keys) if k is not None]

        for batch in sliced(batches):
            for d, i, text in zip(batch.column("digest").to_pylist(), batch.column("id").to_pylist(), text_column(batch, "text"), strict=True):
                if index.insert(d, i, 1, text):
                    held += len(text)
                if held >= most_chars or len(index) >= most_live:
                    yield from _batches(rows(), _MET_ARROW, 500)
                    index, held = CuckooIndex(), 0
        yield from _batches(rows(), _MET_ARROW, 500)

    return run


def _indexed(most_live: int):
    """A partition's rows (digest, keep_id, group_size, text) in order of their digests, so that a bucket's contents are at
    hand one after the other: those of digests that have passed are dropped, and a full index is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = CuckooIndex(), None
        for batch in sliced(batches):
            for d, i, n, text in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size")), text_column(batch, "text"), strict=True):
                if d != last:
                    index.forget()
                    if len(index) >= most_live:
                        yield from _batches(list(index.items()), _ARROW)
                        index = CuckooIndex()
                    last = d
                index.insert(d, i, n, text)
        yield from _batches(list(index.items()), _ARROW)

    return run


def texts_by_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(ids(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def build_index(found: DataFrame, partitions: int) -> DataFrame:
    """Digest index of rows (id, text, digest): equal texts meet first in each input task, then in their digest's partition.

    Every hit, in either place, is verified against the content. A text that a third of all rows share leaves an input
    task once each time that MOST_CHARS of distinct texts are full, so no partition gets more than a few rows a task for
    it. A task holds MOST_LIVE digests at most, and of the second kind one content.
    """
    met = found.select("digest", "id", "text").mapInArrow(_met(MOST_CHARS, MOST_LIVE), _MET)
    return met.repartition(partitions, "digest").sortWithinPartitions("digest").mapInArrow(_indexed(MOST_LIVE), INDEX_SCHEMA)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, partitions: int) -> DataFrame:
    """The index after deleting `deletes` (digest) and then inserting `inserts` (digest, keep_id, group_size).

    Null ids in the index are the smallest. A digest to delete that isn't live makes no difference."""
    none = F.lit(None).cast("long")
    moves = index.withColumn("op", F.lit(0)).unionByName(deletes.select("digest", none.alias("keep_id"), none.alias("group_size"), F.lit(1).alias("op"))).unionByName(inserts.select("digest", "keep_id", "group_size", F.lit(2).alias("op")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:
            for d, i, n, op in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size", "op")), strict=True):
                if op == 1:
                    live.delete(d)
                else:
                    live.insert(d, i, n)
        yield from _batches(list(live.items()), _ARROW)

    return moves.repartition(partitions, "digest").sortWithinPartitions("op").mapInArrow(run, INDEX_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays.

    Null texts count as empty, and empty texts are equal to each other. A null id counts as the smallest; keep_id is
    null where no text of the group has an id. Rows that repeat id and text are rows of the group (group_size counts
    them), and all with the largest id are kept: they are the same document. Other columns aren't looked at.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = texts_by_digest(docs, id_col, text_col)
    index = written(build_index(found, partitions), "index")
    return found.select("id", "digest").join(index, "digest").select(
        back("id").alias("doc_id"),
        back("keep_id").alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with exact copies dropped; of rows that repeat id and text, one stays. Columns as they were.

    Of a group's rows those with its largest id stay (where no row has an id, those without one): rows without an id, or
    with one id and different texts, are told apart by their texts.
    """
    found = texts_by_digest(docs, id_col, text_col)
    index = build_index(found, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    i, d = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "digest"))
    gone = written(index.select(F.col("keep_id").alias(i), F.col("digest").alias(d)), "kept")
    keyed = docs.withColumns({i: ids(id_col), d: F.unhex(F.sha2(text_of(text_col), 256))})
    # the kept rows of a digest share one id, so a repeated row is the only way for two to remain
    return keyed.join(gone, [i, d], "left_semi").dropDuplicates([i, d]).drop(i, d)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d
"""
