"""Token ids in directly addressable codes: files in which any token can be read without decoding a block."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import back, encoder_of, filesystem, ids, new_folder, put_file, sliced, text_column, written

MAGIC = b"QDAC0001"
#: Bits of an id held at each level; the last level takes what is left.
CHUNK_BITS = 8
#: Bits of a continuation bitmap for each entry of its rank directory.
RANK_BLOCK = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Levels:
    """Ids as chunk levels. Level 0 holds the low bits of every id; a set continuation bit says that the next level holds
    more of it, at the rank of that bit. A rank directory has the number of set bits before each RANK_BLOCK bits."""

    def __init__(self, chunks: list[np.ndarray], more: list[np.ndarray], ranks: list[np.ndarray]):
        self.chunks, self.more, self.ranks = chunks, more, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> "Levels":
        values, chunks, more, ranks = values.astype(np.uint64), [], [], []
        while True:
            chunks.append((values & np.uint64(2**CHUNK_BITS - 1)).astype(np.uint8))
            rest = values >> np.uint64(CHUNK_BITS)
            goes_on = rest > 0
            bits = np.packbits(goes_on, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BLOCK // 8), np.uint8)])
            counts = _POPCOUNT[bits].reshape(-1, RANK_BLOCK // 8).sum(axis=1, dtype=np.uint64)
            more.append(bits)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u8"))
            if not goes_on.any():
                return cls(chunks, more, ranks)
            values = rest[goes_on]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def get(self, i: int) -> int:
        """The id at place i, from one byte, one bit and one rank a level."""
        value, shift = 0, 0
        for chunk, more, rank in zip(self.chunks, self.more, self.ranks, strict=True):
            value |= int(chunk[i]) << shift
            byte = i >> 3
            if not (more[byte] >> (i & 7)) & 1:
                break
            block = byte // (RANK_BLOCK // 8)
            within = int(_POPCOUNT[more[block * (RANK_BLOCK // 8) : byte]].sum()) + bin(more[byte] & ((1 << (i & 7)) - 1)).count("1")
            i = int(rank[block]) + within
            shift += CHUNK_BITS
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, which the ranks of its ends find at each level."""
        out = self.chunks[0][start:stop].astype(np.uint64)
        at, shift = np.arange(len(out)), 0
        for k, more in enumerate(self.more[:-1] if len(self.more) > 1 else []):
            bits = np.unpackbits(more[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + stop - start].astype(bool)
            first = self.rank(k, start)
            start, stop = first, first + int(bits.sum())
            at, shift = at[bits], shift + CHUNK_BITS
            out[at] |= self.chunks[k + 1][start:stop].astype(np.uint64) << np.uint64(shift)
        return out

    def rank(self, level: int, i: int) -> int:
        more, block = self.more[level], i // RANK_BLOCK
        byte = i >> 3
        partial = bin(int(more[byte]) & ((1 << (i & 7)) - 1)).count("1") if i & 7 else 0
        return int(self.ranks[level][block]) + int(_POPCOUNT[more[block * (RANK_BLOCK // 8) : byte]].sum()) + partial


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> bytes:
    """A file: magic, counts, the documents' ids and starts, then for each level its chunks, bitmap and ranks."""
    levels = Levels.of(values)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    parts = [MAGIC, struct.pack("<QQI", len(doc_ids), len(values), len(levels.chunks)), doc_ids.astype("<i8").tobytes(), starts.tobytes()]
    for chunk, more, rank in zip(levels.chunks, levels.more, levels.ranks, strict=True):
        parts += [struct.pack("<QQQ", len(chunk), len(more), len(rank)), chunk.tobytes(), more.tobytes(), rank.tobytes()]
    return b"".join(parts)


def from_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, Levels]:
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, _, n = struct.unpack_from("<QQI", raw, 8)
    at = 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, starts = take("<i8", docs), take("<i8", docs + 1)
    chunks, more, ranks = [], [], []
    for _ in range(n):
        c, m, r = struct.unpack_from("<QQQ", raw, at)
        at += 24
        chunks.append(take("u1", c))
        more.append(take("u1", m))
        ranks.append(take("<u8", r))
    return doc_ids, starts, Levels(chunks, more, ranks)


_FILES = "part long, file long, path string, documents long, tokens long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens_per_file: int = 8_000_000) -> DataFrame:
    """Write the documents' ids in ascending order of id and return a row for each file: part, file, path, documents, tokens.

    A range partition writes a new file whenever it holds `tokens_per_file` ids, so a task's memory doesn't follow the
    size of its partition. Each attempt of a task writes files of its own; only those of finished tasks are named in the result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(ids(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = encoder_of(vocabulary), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        names: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            path = f"{folder}/part-{part:06d}-{made:05d}.dac"
            values = np.frombuffer(b"".join(held), "<u4")
            path = put_file(path, to_bytes(np.array(names, np.int64), np.array([len(x) // 4 for x in held], np.int64), values))
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [made], "path": [path], "documents": [len(names)], "tokens": [len(values)]})
            made, size = made + 1, 0
            held.clear()
            names.clear()
            return row

        for batch in sliced(batches):
            for id_, text in zip(batch.column("id").to_pylist(), text_column(batch, "text"), strict=True):
                held.append(encoder.ids_of(text) + end)
                names.append(id_)
                size += len(held[-1]) // 4
                if size >= tokens_per_file:
                    yield flush()
        if names:
            yield flush()

    return ordered.mapInArrow(run, _FILES)


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document of the files (path, base): id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    doc_ids, starts, levels = from_bytes(f.read())
                n = len(doc_ids)
                for k in range(0, n, 1000):
                    stop = min(n, k + 1000)
                    values = levels.slice(int(starts[k]), int(starts[stop])).astype("<u4")
                    at = starts[k : stop + 1] - starts[k]
                    crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"id": doc_ids[k:stop], "start": starts[k:stop] + base, "n_tokens": np.diff(starts[k : stop + 1]), "ids_crc32": np.array(crc, np.int64)})

    return files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens_per_file: int = 8_000_000) -> DataFrame:
    """One row per document, read from its token-id file: doc_id, start, n_tokens, ids_crc32.

    Null texts count as empty and hold the end id alone. Null ids come first; documents with one id are in the order of
    their texts. Other columns aren't looked at. An empty table gives no rows. Where a file begins is a running sum over
    its partition's files, and over one row a partition; the driver sees none of it.
    """
    spark = docs.sparkSession
    made = written(write_token_files(docs, new_folder(spark, "token-ids"), vocabulary, end_id, id_col, text_col, tokens_per_file), "token-files")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = made.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    within = made.select("part", "path", before(Window.partitionBy("part").orderBy("file")).alias("within"))
    files = within.join(parts, "part").select("path", (F.col("base") + F.col("within")).alias("base"))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return read_token_files(files).select(back("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
