"""Packing of tokenised documents into windows by the sum-of-squares rule."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import back, encoder_of, ids, sliced, text_column

WINDOW = 4096
#: Open windows of a task at most; beyond that the fullest is closed by cutting pieces of the emptiest into it.
MOST_OPEN = 2048
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


class Piece:
    __slots__ = ("id", "start", "tokens", "total")

    def __init__(self, id_: int, start: int, tokens: bytes, total: int):
        self.id, self.start, self.tokens, self.total = id_, start, tokens, total

    def __len__(self) -> int:
        return len(self.tokens) // 4

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.id, self.start, self.tokens[: 4 * n], self.total), Piece(self.id, self.start + n, self.tokens[4 * n :], self.total)


class SumOfSquares:
    """Online packing. counts[h] is the number of open windows filled to level h (0 < h < window).

    A piece of s tokens goes to the level h for which the sum of squared counts becomes least: moving a window from h to
    h + s changes it by 2 * (counts[h + s] - counts[h]) + 2, filling it up by 1 - 2 * counts[h], and a new window by
    2 * counts[s] + 1. Ties go to the fuller window.
    """

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; yields the windows that are full now."""
        while len(piece) > self.window:
            head, piece = piece.cut(self.window)
            yield [head]
        s = len(piece)
        if s == self.window:
            yield [piece]
            return
        cost = np.full(self.window + 1, np.iinfo(np.int64).max)
        room = self.window - s
        at = np.flatnonzero(self.counts[1:room]) + 1
        cost[at] = 2 * (self.counts[at + s] - self.counts[at]) + 2
        if self.counts[room]:
            cost[room] = 1 - 2 * self.counts[room]
        cost[0] = 2 * self.counts[s] + 1
        best = self.window - int(np.argmin(cost[::-1]))
        held = self._take(best) if best else []
        held.append(piece)
        if best + s == self.window:
            yield held
        else:
            self._put(best + s, held)
        if self.open > self.most_open:
            yield from self._close(self.open - self.most_open // 2)

    def _take(self, level: int) -> list[Piece]:
        held = self.levels[level].pop()
        self.counts[level] -= 1
        self.open -= 1
        return held

    def _put(self, level: int, held: list[Piece]) -> None:
        self.levels.setdefault(level, []).append(held)
        self.counts[level] += 1
        self.open += 1

    def _close(self, n: int) -> Iterator[list[Piece]]:
        """Make n open windows into full ones, fullest first, by cutting the pieces of the emptiest; what is left stays open."""
        order = np.repeat(np.arange(self.window + 1), self.counts)
        windows = [(int(h), self._take(int(h))) for h in [*order[len(order) - n // 2 :][::-1], *order[: n - n // 2]]]
        low, high, spare = len(windows) - 1, 0, []
        while high <= low:
            level, held = windows[high]
            while level < self.window:
                if not spare:
                    if low <= high:
                        break
                    spare = windows[low][1]
                    low -= 1
                piece = spare.pop()
                if len(piece) > self.window - level:
                    piece, rest = piece.cut(self.window - level)
                    spare.append(rest)
                held.append(piece)
                level += len(piece)
            if level == self.window:
                yield held
            else:
                self._put(level, held)
            high += 1
        if spare:
            self._put(sum(map(len, spare)), spare)

    def finish(self) -> Iterator[list[Piece]]:
        """Close all windows. The one that can't be filled is cut to lengths that are powers of two, which need no padding."""
        while self.open > 1:
            yield from self._close(self.open)
        if self.open:
            held = self._take(int(np.flatnonzero(self.counts)[0]))
            held.reverse()
            total = sum(map(len, held))
            for bit in reversed(range(self.window.bit_length())):
                if total >> bit & 1:
                    out, need = [], 1 << bit
                    while need:
                        piece = held.pop()
                        if len(piece) > need:
                            piece, rest = piece.cut(need)
                            held.append(rest)
                        out.append(piece)
                        need -= len(piece)
                    yield out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input task tokenises and packs its own documents, so nothing is shuffled; at its end only one window can be
    left unfilled, and that one is cut to powers of two. A task has at most MOST_OPEN windows open, which bounds its memory
    to that many windows' ids: beyond them the fullest half are closed by cutting pieces of the emptiest into them, so a
    document may be cut there that a longer wait might have placed whole. sequence_id holds the task's number in its upper
    bits.
    Null and empty texts are the end id alone. Null ids stay null; rows that repeat an id are packed each. Other columns
    aren't looked at. An empty table gives no rows.
    """
    rows = docs.select(ids(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(vocabulary), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple[int, ...]] = []

        def add(held: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in held:
                out.append((p.id, p.start, len(p), zlib.crc32(p.tokens), p.total, sequence, offset))
                offset += len(p)
            sequence += 1

        def rows() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(_ARROW))], schema=_ARROW)
            out.clear()
            return got

        for batch in sliced(batches):
            for id_, text in zip(batch.column("id").to_pylist(), text_column(batch, "text"), strict=True):
                tokens = encoder.ids_of(text) + end
                for held in packer.place(Piece(id_, 0, tokens, len(tokens) // 4)):
                    add(held)
            yield rows()
        for held in packer.finish():
            add(held)
        yield rows()

    return rows.mapInArrow(run, PIECES).withColumn("doc_id", back("id")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
