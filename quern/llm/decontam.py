"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import keep_rows, sliced, text_column, text_of, written

#: Edits allowed for each character of an item.
ERROR_RATE = 0.1
#: Items shorter than this many characters (after normalisation) must occur without an edit.
LEAST_LENGTH = 24
#: Characters of items in one pass over the documents: it bounds the automaton that each task builds.
PASS_CHARS = 4_000_000


def normal(text: str) -> str:
    """A-Z and other letters lower-cased, runs of white space one space, no space at the ends."""
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, most: int) -> int:
    """The least edit distance of the pattern to any part of the text, or -1 if it is more than `most`.

    Myers' bit-parallel algorithm with the pattern's columns in one integer of as many bits.
    """
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(x | plus))
        down = plus & x
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        up = (up << 1) & full
        down = (down << 1) & full
        y = eq | minus
        plus = down | (full & ~(y | up))
        minus = up & y
    return best if best <= most else -1


def budget(length: int) -> int:
    return 0 if length < LEAST_LENGTH else int(length * ERROR_RATE)


def tree(length: int, edits: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """edits + 1 pieces (start, stop) of an item, each with the nodes (start, stop, edits) above it up to the whole.

    A node over n pieces may have n - 1 edits. Where the whole has no more than its budget, so has one of the halves of
    each node on some way down to a piece without an edit. A piece's hit is therefore followed upwards, and most chance
    hits end at the node of two pieces.
    """
    n = edits + 1
    cuts = [length * i // n for i in range(n + 1)]
    out: list[tuple[int, int, list[tuple[int, int, int]]]] = []

    def split(a: int, b: int, above: list[tuple[int, int, int]]) -> None:
        if b - a == 1:
            out.append((cuts[a], cuts[b], above[::-1]))
            return
        above = [*above, (cuts[a], cuts[b], b - a - 1)]
        split(a, (a + b) // 2, above)
        split((a + b) // 2, b, above)

    split(0, n, [])
    return out


class Matcher:
    """Finds items in normalised texts within their error budgets."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(i, t, budget(len(t))) for i, t in ((i, normal(t)) for i, t in items) if t]
        at: dict[str, list[tuple[int, int, list[tuple[int, int, int]]]]] = {}
        for k, (_, t, edits) in enumerate(self.items):
            for start, stop, above in tree(len(t), edits):
                at.setdefault(t[start:stop], []).append((k, start, above))
        self.automaton = ahocorasick.Automaton() if at else None
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """(item, edits) of each item in the text; edits is the least distance to any part of it.

        A match within the budget lies within `budget` characters of where one of its pieces puts it. Where such a place
        is confirmed, the distance is taken over all that the place's other pieces could reach too, so that those hits
        are no news; every hit outside of what was looked at is followed anew.
        """
        if self.automaton is None:
            return []
        text = normal(text)
        best: dict[int, int] = {}
        seen: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, start, above in places:
                if best.get(k) == 0:
                    continue
                begin = end + 1 - size - start  # where the item would begin without edits
                _, item, most = self.items[k]
                low, high = max(0, begin - most), min(len(text), begin + len(item) + most)
                if any(a <= low and high <= b for a, b in seen.get(k, ())):
                    continue
                if any(myers(item[a:b], text[max(0, begin + a - edits) : begin + b + edits], edits) < 0 for a, b, edits in above[:-1]):
                    continue
                low, high = max(0, begin - 3 * most), min(len(text), begin + len(item) + 3 * most)
                got = myers(item, text[low:high], most) if most else 0
                seen.setdefault(k, []).append((low, high))
                if got >= 0:
                    best[k] = min(got, best.get(k, got))
        return sorted(((self.items[k][0], edits) for k, edits in best.items()), key=lambda x: (x[0] is not None, x))


_last: tuple[str, Matcher] | None = None


def _matcher(held) -> Matcher:
    """The process's matcher for the items that were broadcast last: tasks of one pass share it."""
    global _last
    name, items = held.value
    if _last is None or _last[0] != name:
        _last = name, Matcher(items)
    return _last[1]


def _passes(items: DataFrame, item_col: str, item_text_col: str) -> Iterator:
    """The items in broadcasts of about PASS_CHARS characters, and whether it is the last. Each but the last is released when
    the next is asked for: by then its rows must be written."""
    sc = items.sparkSession.sparkContext
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // PASS_CHARS))
    for k in range(passes):
        part = [(r["item"], r["text"]) for r in wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()]
        held = sc.broadcast((uuid.uuid4().hex, part))
        yield held, k == passes - 1
        if k < passes - 1:
            held.unpersist()


_FOUND = "id long, text string, items array<long>, edits array<int>"
_FOUND_ARROW = pa.schema([("id", pa.int64()), ("text", pa.string()), ("items", pa.list_(pa.int64())), ("edits", pa.list_(pa.int32()))])


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """A row for each row of docs: id, items, edits (arrays of equal length). Rows are never put together by id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumns({"items": F.array().cast("array<long>"), "edits": F.array().cast("array<int>")})
    for held, last in _passes(items, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held)
            for batch in sliced(batches):
                found = [matcher.find(t) for t in text_column(batch, "text")]
                both = [[x + [f[i] for f in got] for x, got in zip(batch.column(c).to_pylist(), found, strict=True)] for i, c in enumerate(("items", "edits"))]
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("id"), text, *map(pa.array, both, _FOUND_ARROW.types[2:])], schema=_FOUND_ARROW)

        rows = rows.mapInArrow(run, _FOUND)
        rows = rows if last else written(rows, "matches")
    return rows.drop("text")


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs and item that it holds: doc_id, item_id, edits (the least distance to a part of the text).

    An item is held if some part of the text, both normalised, is within ERROR_RATE edits a character. The test items'
    size is measured first; beyond PASS_CHARS they are searched for in several passes over the documents, each with its
    own broadcast and written before the next. Null and empty texts and items match nothing. A null item id comes back as
    null. Rows that repeat an id, or have none, are searched each. Other columns aren't looked at. An empty table gives no
    rows.
    """
    found = _found(docs, items, id_col, text_col, item_col, item_text_col)
    return found.select(F.col("id").alias("doc_id"), F.explode(F.arrays_zip("items", "edits")).alias("x")).select("doc_id", F.col("x.items").alias("item_id"), F.col("x.edits").cast("long").alias("edits"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_ids (ascending, distinct, without null), least_edits (null if there
    are none). Rows that repeat an id, or have none, are judged each by its own text. Otherwise as find_items."""
    found = _found(docs, items, id_col, text_col, "item_id", "text")
    names = F.sort_array(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    return found.select(F.col("id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), names.alias("item_ids"), F.array_min("edits").cast("long").alias("least_edits"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, columns as they were. Each is decided on by its own text where it is read; null
    and empty texts stay. Beyond one pass the rows that are left are written after each."""
    for held, last in _passes(items, "item_id", "text"):

        def wanted(held=held):
            matcher = _matcher(held)
            return lambda texts: [not matcher.find(t) for t in texts]

        docs = keep_rows(docs, text_col, wanted)
        docs = docs if last else written(docs, "clean")
    return docs
