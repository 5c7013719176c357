"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, back, byte_column, filesystem, ids, mix, new_folder, put_named, sliced, text_of, words_of, written
from quern.llm.language import fold

#: Counts are held as levels: up to the first number a level for each count, beyond it levels that grow by the second.
SCALES = {1: (64, 1.01), 2: (32, 1.03), 3: (256, 1.01)}
BITS_PER_ITEM, PROBES = 20, 8
#: Exact counts of the commonest words that are broadcast; those of other words come from a join.
MOST_EXACT = 1_000_000
#: What is taken off a bigram's count for words not yet seen after its first word.
DISCOUNT = 0.75
#: Share of the unigram distribution after any word, at least.
LEAST_UNIGRAM = 0.02
#: Bytes of text after which a block of documents is full. A block's n-grams are counted and probed once each.
BLOCK_BYTES = 1_500_000
#: Blocks whose n-grams of one order a task gets, about: buckets and tasks become more with the blocks.
BLOCKS_A_BUCKET = 12

END = np.uint64(0x5A17E4D30F6B92C1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of counts. SEEN is a context's discounted count of bigrams, held in quarters, which are exact.
UNIGRAM, BIGRAM, SEEN = 1, 2, 3
_LOW = np.uint64(0xFFFFFFFF)


def context_of(words: np.ndarray) -> np.ndarray:
    """The upper half of the word's hash: a word and what is known of the words after it have the same bucket."""
    return words >> np.uint64(32)


def context_key(context: np.ndarray) -> np.ndarray:
    return (context << np.uint64(32)) | (mix(context) & _LOW)


def bigrams(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The pair's hash in the upper half, which deals pairs of one context to all buckets; the context in the lower."""
    context = context_of(before)
    return (mix(context + words * np.uint64(0xA0761D6478BD642F)) & ~_LOW) | context


class _Tokens:
    """Token hashes of texts: words, then the end."""

    def __init__(self):
        self.hashes = WordHashes()

    def of(self, raw: bytes) -> np.ndarray:
        words = words_of(raw)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = self.hashes.of(words)
        out[-1] = END
        return out


_PACKED = "block long, ids binary, text_hashes binary, trained binary, sizes binary, texts binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "text_hashes", "trained", "sizes", "texts"))])
_BLOCK = "gram int, bucket int, block long, hashes binary, counts binary"
_BLOCK_ARROW = pa.schema([("gram", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_MERGED = "gram int, bucket int, block long, hashes binary, counts binary, total long, distinct long, at array<long>, levels binary"
_MERGED_ARROW = pa.schema([*_BLOCK_ARROW, ("total", pa.int64()), ("distinct", pa.int64()), ("at", pa.list_(pa.int64())), ("levels", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _packed(block_bytes: int):
    """A task's documents (id, text_hash, trained, text) in blocks, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room, n = [], block_bytes, 0

        def row() -> pa.RecordBatch:
            i, h, trained, raws = zip(*held, strict=True)
            got = (TaskContext.get().partitionId() << 32 | n, np.array(i, "<i8"), np.array(h, "<i8"), np.array(trained, bool), np.array([len(r) for r in raws], "<u4"))
            return _rows([(got[0], *(x.tobytes() for x in got[1:]), b"".join(raws))], _PACKED_ARROW).to_batches()[0]

        for batch in sliced(batches):
            for x in zip(*(batch.column(c).to_pylist() for c in ("id", "text_hash", "trained")), byte_column(batch, "text"), strict=True):
                held.append(x)
                room -= len(x[3])
                if room <= 0:
                    yield row()
                    held, room, n = [], block_bytes, n + 1
        if held:
            yield row()

    return run


def _planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes and so on: bytes that are mostly zero lie together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _of_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(kind).reshape(-1)


def _steps(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the steps between them."""
    return _planes(np.diff(hashes.astype("<u8"), prepend=np.zeros(1, "<u8")))


def _of_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(raw, "<u8"), dtype=np.uint64)


def _texts(raw: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
    return [raw[x:y] for x, y in zip([0, *ends], ends)]


def _cut(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted hashes: a bucket is the upper bits."""
    cuts = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
    return [(b, x, y) for b, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(hashes)])) if y > x]


def _counted(bits: int):
    """A block's distinct n-grams, sorted, with their counts in its training texts, in a row for each order and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            for r in range(batch.num_rows):
                block, trained, sizes, raw = (batch.column(c)[r].as_py() for c in ("block", "trained", "sizes", "texts"))
                ones = [tokens.of(t) for t in _texts(raw, sizes)]
                counts_in = np.repeat(np.frombuffer(trained, bool), [len(t) for t in ones])
                twos = np.concatenate([bigrams(np.concatenate([[END], t[:-1]]), t) for t in ones])
                ones = np.concatenate(ones)
                for order, all_ in ((UNIGRAM, ones), (BIGRAM, twos)):
                    hashes, at = np.unique(all_, return_inverse=True)
                    counts = np.bincount(at, counts_in, len(hashes)).astype("<u4")
                    yield from _rows([(order, b, block, _steps(hashes[x:y]), _planes(counts[x:y])) for b, x, y in _cut(hashes, bits)], _BLOCK_ARROW).to_batches()

    return run


def levels(counts: np.ndarray, gram: int) -> np.ndarray:
    """Quantised counts, 1 for a count of one."""
    linear, base = SCALES[gram]
    beyond = linear + np.floor(np.log(np.maximum(counts, linear) / linear) / np.log(base) + 1e-9).astype(np.int64)
    return np.where(counts <= linear, counts, beyond)


def least_at(level: int, gram: int) -> int:
    """The least count of a level."""
    linear, base = SCALES[gram]
    return level if level <= linear else int(np.ceil(linear * base ** (level - linear) - 1e-6))


def count_at(level: np.ndarray, gram: int) -> np.ndarray:
    """The count that a level stands for, its middle, so that sums of counts aren't biased; 0 for level 0."""
    linear, base = SCALES[gram]
    count = np.where(level <= linear, level, linear * base ** (np.maximum(level, linear) - float(linear)) * (1 + base) / 2)
    return count / 4 if gram == SEEN else count


def _contexts(hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """The discounted counts of some bigrams by context, in rows by bucket."""
    context, at = np.unique(hashes & _LOW, return_inverse=True)
    kept = np.rint(4 * np.bincount(at, counts - DISCOUNT, len(context))).astype("<i8")
    keys = context_key(context)
    for b, x, y in _cut(keys, bits):
        yield SEEN, b, None, _steps(keys[x:y]), _planes(kept[x:y]), None, None, None, None


def _merge(table: pa.Table, bits: int, bits_per_item: int, pairs: bool) -> pa.Table:
    """One bucket's counts added up, with how many n-grams are at each level, and each block's levels from the bucket's
    segment of the filter. A block's row for words also has their places among the bucket's, of which those that no
    training text holds have a count of 0. Of bigrams what is handed on are their contexts' counts and, if `pairs`, they
    themselves."""
    order, bucket = table.column("gram")[0].as_py(), table.column("bucket")[0].as_py()
    blocks, tallies = table.column("block").to_pylist(), table.column("counts").to_pylist()
    parts = [_of_steps(h) for h in table.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    counts = np.concatenate([_of_planes(n, "<u4") for n in tallies]).astype(np.int64)
    by = np.argsort(hashes, kind="stable")
    hashes = hashes[by]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    starts = np.flatnonzero(new)
    at = np.empty(len(by), np.int64)
    at[by] = np.cumsum(new) - 1
    hashes, counts = hashes[starts], np.add.reduceat(counts[by], starts)
    total, level = int(counts.sum()), levels(counts, order)
    filter_ = segment(hashes, level, bits_per_item)
    # what several blocks ask for is probed once
    got = probe(filter_, np.full(len(hashes), 8 * len(filter_), np.uint64), np.zeros(len(hashes), np.uint64), hashes).astype("<u2")
    rows, keep = [], counts > 0
    if order == UNIGRAM or pairs:
        rows.append((order, bucket, None, _steps(hashes), _planes(counts.astype("<i8")), total, int(keep.sum()), np.bincount(level).tolist(), None))
    if order == BIGRAM:
        rows += _contexts(hashes[keep], counts[keep], bits)
    ends = np.cumsum([len(h) for h in parts]).tolist()
    for block, x, y in zip(blocks, [0, *ends], ends):
        places = _planes(np.diff(at[x:y], prepend=0).astype("<u4")) if order == UNIGRAM else None
        rows.append((order, bucket, block, places, None, None, None, None, _planes(got[at[x:y]])))
    return _rows(rows, _MERGED_ARROW)


def _merge_contexts(table: pa.Table, bits_per_item: int) -> pa.Table:
    """One bucket's contexts with their discounted counts added up, and the levels of each block's words as contexts.

    Rows of SEEN have counts; the row of words without a block has the bucket's words, those with one a block's places
    among them.
    """
    kinds, blocks, raws, tallies = (table.column(c).to_pylist() for c in ("gram", "block", "hashes", "counts"))
    seen = [(_of_steps(h), _of_planes(n, "<i8")) for k, h, n in zip(kinds, raws, tallies, strict=True) if k == SEEN]
    hashes = np.concatenate([np.empty(0, np.uint64), *(h for h, _ in seen)])
    hashes, at = np.unique(hashes, return_inverse=True)
    counts = np.bincount(at, np.concatenate([np.empty(0, np.int64), *(n for _, n in seen)]), len(hashes)).astype(np.int64)
    level, bucket = levels(counts, SEEN), table.column("bucket")[0].as_py()
    bits = segment(hashes, level, bits_per_item)
    rows = [(SEEN, bucket, None, _steps(hashes), _planes(counts.astype("<i8")), int(counts.sum()), len(hashes), np.bincount(level).tolist(), None)]
    words = next((_of_steps(h) for k, b, h in zip(kinds, blocks, raws, strict=True) if k == UNIGRAM and b is None), np.empty(0, np.uint64))
    keys, which = np.unique(context_key(context_of(words)), return_inverse=True)
    got = probe(bits, np.full(len(keys), 8 * len(bits), np.uint64), np.zeros(len(keys), np.uint64), keys).astype("<u2")[which]
    for k, block, raw in zip(kinds, blocks, raws, strict=True):
        if k == UNIGRAM and block is not None:
            rows.append((SEEN, bucket, block, None, None, None, None, None, _planes(got[np.cumsum(_of_planes(raw, "<u4"), dtype=np.int64)])))
    return _rows(rows, _MERGED_ARROW)


def count(blocks: DataFrame, pairs: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The n-gram counts of all blocks' training texts, a row for each order and bucket (bigrams only if `pairs`); what the
    filter has for each block's n-grams (block, gram, bucket, levels); and the bits that number a bucket.

    The number of buckets and of tasks follows the number of blocks, so that neither a row nor a task grows with the
    corpus."""
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // BLOCKS_A_BUCKET)
    bits, item_bits = max(2, (parts - 1).bit_length()), BITS_PER_ITEM
    rows = blocks.select("block", "trained", "sizes", "texts").mapInArrow(_counted(bits), _BLOCK)
    words = rows.repartition(parts, "gram", "bucket").groupBy("gram", "bucket").applyInArrow(lambda t: _merge(t, bits, item_bits, pairs), _MERGED)
    words = written(words, "counts", "zstd")
    of_all, of_block = F.col("block").isNull(), F.col("block").isNotNull()
    asked = words.filter(F.col("gram") != BIGRAM).select(*_BLOCK_ARROW.names)
    found = written(asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(lambda t: _merge_contexts(t, item_bits), _MERGED), "contexts", "zstd")
    words = words.filter(F.col("gram") != SEEN).unionByName(found)
    return words.filter(of_all).drop("block", "levels"), words.filter(of_block).select("block", "gram", "bucket", "levels"), bits


def _keys(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix(hashes + np.uint64(int(_STEP) * int(level) % 2**64))


def _position(keys: np.ndarray, probe: int, sizes: np.ndarray) -> np.ndarray:
    """Where a key's bit is: the upper half of keys + probe * odd step, scaled to the segment's size."""
    x = keys + ((keys * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)) * np.uint64(probe)
    return ((x >> np.uint64(32)) * sizes) >> np.uint64(32)


def segment(hashes: np.ndarray, level: np.ndarray, bits_per_item: int = BITS_PER_ITEM) -> np.ndarray:
    """A bucket's part of the filter: each n-gram is entered once for each of its levels."""
    q = 1
    size = max(64, -(-int(level.sum()) * bits_per_item // 8) * 8)
    bits = np.zeros(size, bool)
    while True:
        keep = level >= q
        hashes, level = hashes[keep], level[keep]
        if not len(hashes):
            return np.packbits(bits, bitorder="little")
        keys = _keys(hashes, q)
        for i in range(PROBES):
            bits[_position(keys, i, np.uint64(size)).astype(np.int64)] = True
        q += 1


def probe(bits: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Levels by repeated membership probes: level after level until the filter says no."""
    level, live, q = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 1
    while len(live):
        keys = _keys(hashes[live], q)
        for i in range(PROBES):  # a key that one probe refutes isn't probed again
            at = _position(keys, i, sizes[live]) + offsets[live]
            yes = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            keys, live = keys[yes], live[yes]
        level[live] = q
        q += 1
    return level


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for order, bucket, raw, n in zip(*(batch.column(c).to_pylist() for c in ("gram", "bucket", "hashes", "counts")), strict=True):
            bits = segment(_of_steps(raw), levels(_of_planes(n, "<i8"), order))
            yield pa.RecordBatch.from_pydict({"gram": pa.array([order], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


class Common:
    """The exact counts of the commonest words, and the totals."""

    def __init__(self, exact: tuple[np.ndarray, np.ndarray], total: int, distinct: int):
        self.exact_hashes, self.exact_counts = exact
        self.total, self.distinct = total, distinct

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts of common words; -1 for other words."""
        if not len(self.exact_hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.exact_hashes, hashes), len(self.exact_hashes) - 1)
        return np.where(self.exact_hashes[at] == hashes, self.exact_counts[at], -1)


class Model:
    """All of the filter's segments in one place, and the totals."""

    def __init__(self, bits: int, segments: dict[tuple[int, int], bytes], common: Common):
        self.bits, self.total, self.distinct = bits, common.total, common.distinct
        self.filter, self.offset, self.size = {}, {}, {}
        for order in SCALES:
            parts = [np.frombuffer(segments.get((order, b), bytes(8)), np.uint8) for b in range(1 << bits)]
            self.filter[order] = np.concatenate(parts)
            self.size[order] = np.array([8 * len(p) for p in parts], np.uint64)
            self.offset[order] = np.concatenate([[0], np.cumsum([8 * len(p) for p in parts])])[:-1].astype(np.uint64)

    def counts(self, hashes: np.ndarray, order: int) -> np.ndarray:
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return count_at(probe(self.filter[order], self.size[order][bucket], self.offset[order][bucket], hashes), order)


def probability(context: np.ndarray, seen: np.ndarray, both: np.ndarray, word: np.ndarray, single: np.ndarray) -> np.ndarray:
    """P(v | u) of c(u), s(u), c(u v), c(v) and p(v). A pair can't be commoner than its words or than all pairs of its
    context, which refutes most of the filter's false answers."""
    both = np.where((seen > 0) & (word > 0), np.minimum(both, np.minimum(word, seen + DISCOUNT)), 0)
    context = np.maximum(context, seen)
    known = (1 - LEAST_UNIGRAM) / np.maximum(context, 1)
    return known * np.maximum(both - DISCOUNT, 0) + (1 - known * seen) * single


def _blocks(docs: DataFrame, id_col: str, text_col: str, trained) -> DataFrame:
    """The documents in blocks, as a written table; trained says of which documents n-grams are counted."""
    text = text_of(text_col)
    rows = docs.select(ids(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), trained.alias("trained"), text.alias("text"))
    return written(rows.mapInArrow(_packed(BLOCK_BYTES), _PACKED), "blocks", "zstd")


def commonest(table: DataFrame) -> tuple[Common, int]:
    """The commonest words' exact counts and the totals, and the count below which a word isn't among them."""
    words = table.filter(F.col("gram") == UNIGRAM)
    stats = words.select(F.posexplode("at").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    at = {r["level"]: r["n"] for r in stats}
    sums = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    level, room = max(at, default=1), MOST_EXACT
    while level > 1 and room >= at.get(level, 0):
        room -= at.get(level, 0)
        level -= 1
    cut = least_at(level + 1 if room < at.get(level, 0) else level, UNIGRAM) if at else 1

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, n in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = _of_planes(n, "<i8")
                keep = n >= cut
                yield pa.RecordBatch.from_pydict({"hashes": [_of_steps(raw)[keep].tobytes()], "counts": [n[keep].tobytes()]})

    rows = words.select("hashes", "counts").mapInArrow(common, "hashes binary, counts binary").collect()
    hashes = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["hashes"], "<u8") for r in rows)])
    counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["counts"], "<i8") for r in rows)])
    by = np.argsort(hashes)
    return Common((hashes[by], counts[by]), int(sums[0]), int(sums[1])), cut


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame, int]:
    """The whole filter on the driver, for tables that are small; the table of all counts; and commonest's count.
    score_lm never brings the segments together."""
    table, _, bits = count(_blocks(docs.withColumn("__id", F.lit(0)), "__id", text_col, F.lit(True)), pairs=True)
    found = table.select("gram", "bucket", "hashes", "counts").mapInArrow(_segments, "gram int, bucket int, bits binary").collect()
    common, cut = commonest(table)
    return Model(bits, {(r["gram"], r["bucket"]): bytes(r["bits"]) for r in found}, common), table, cut


def _put_levels(uri: str):
    """Writes a block's levels as a file: by order the number of its n-grams, then all levels in the order of hashes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("gram", "ascending"), ("bucket", "ascending")])
        block, parts = table.column("block")[0].as_py(), {o: [] for o in SCALES}
        for order, raw in zip(table.column("gram").to_pylist(), table.column("levels").to_pylist(), strict=True):
            parts[order].append(_of_planes(raw, "<u2"))
        joined = [np.concatenate([np.empty(0, "<u2"), *parts[o]]) for o in SCALES]
        raw = np.array([len(x) for x in joined], "<u8").tobytes() + _planes(np.concatenate(joined))
        put_named(f"{uri}/{block}", zstandard.ZstdCompressor().compress(raw))
        return pa.table({"block": pa.array([block], pa.int64())})

    return run


def _levels(uri: str, block: int) -> dict[int, np.ndarray]:
    fs, path = filesystem(f"{uri}/{block}")
    with fs.open_input_stream(path, compression=None) as f:
        raw = zstandard.ZstdDecompressor().decompress(f.read())
    ends = np.cumsum(np.frombuffer(raw, "<u8", len(SCALES))).tolist()
    all_ = _of_planes(raw[8 * len(SCALES) :], "<u2").astype(np.int64)
    return {o: all_[int(x) : int(y)] for o, x, y in zip(SCALES, [0, *ends], ends)}


_SCORED = "id long, text_hash long, n_tokens long, n_common long, common_score double, score double, rare array<long>, times array<long>"


def _scored(held, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, tokens = held.value, _Tokens()
        room = np.log10(common.total + common.distinct + 1.0)
        for batch in batches:
            for r in range(batch.num_rows):
                block, i, text_hashes, sizes, raw = (batch.column(c)[r].as_py() for c in ("block", "ids", "text_hashes", "sizes", "texts"))
                found = _levels(uri, block)
                parts = [tokens.of(t) for t in _texts(raw, sizes)]
                sizes = np.array([len(p) for p in parts])
                starts = np.cumsum(sizes) - sizes
                all_ = np.concatenate(parts)
                before = np.concatenate([[END], all_[:-1]])
                before[starts] = END
                words, at = np.unique(all_, return_inverse=True)
                known = common.exact(words)
                # log10((c + 1) / (N + V + 1)) of the common words
                base = np.where(known >= 0, np.log10(np.maximum(known, 0) + 1.0) - room, 0.0)[at]
                pairs, pair_at = np.unique(bigrams(before, all_), return_inverse=True)
                if [len(words), len(pairs), len(words)] != [len(found[o]) for o in (UNIGRAM, BIGRAM, SEEN)]:
                    raise ValueError(f"block {block}: levels of other n-grams")
                ones = count_at(found[UNIGRAM], UNIGRAM)
                after = count_at(found[SEEN], SEEN)
                single = (ones + 1) / (common.total + common.distinct + 1.0)
                # the word before is the one at the place before; the start is the end's hash
                end = np.searchsorted(words, END)
                before_at = np.concatenate([[end], at[:-1]])
                before_at[starts] = end
                both = count_at(found[BIGRAM], BIGRAM)[pair_at]
                p = probability(ones[before_at], after[before_at], both, ones[at], single[at])
                sums = lambda v: np.add.reduceat(v, starts)
                is_common = known[at] >= 0
                rare, times = [], []
                for p_, s, n in zip(parts, starts, sizes, strict=True):
                    h, n = np.unique(p_[~is_common[s : s + n]], return_counts=True)
                    rare.append(h.view(np.int64))
                    times.append(n)
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(i, "<i8")),
                        pa.array(np.frombuffer(text_hashes, "<i8")),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums(is_common.astype(np.int64)), pa.int64()),
                        pa.array(sums(base), pa.float64()),
                        pa.array(sums(np.log10(p)), pa.float64()),
                        pa.array(rare, pa.list_(pa.int64())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    names=["id", "text_hash", "n_tokens", "n_common", "common_score", "score", "rare", "times"],
                )
                yield from sliced([out])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, n in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            hashes, counts = _of_steps(raw).view(np.int64), _of_planes(n, "<i8")
            for i in range(0, len(hashes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + 50_000]), pa.array(counts[i : i + 50_000])], names=["h", "c"])


def score_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score (a token's).

    Counts come from all documents outside the held-out fold; all of them are in the filter, those of 1 too. score adds up
    log10 of l * max(0, c(u v) - DISCOUNT) / c(u) + (1 - l * s(u) / c(u)) * p(v), where l is 1 - LEAST_UNIGRAM,
    p(v) = (c(v) + 1) / (N + V + 1) and s(u) what c(u v) - DISCOUNT adds up to over all v; all counts are read from the
    filter, c(u) as s(u) at least and c(u v) as the lesser of it, c(v) and s(u) + DISCOUNT at most. The start of a text
    counts as an end. base_score has exact counts: those of the MOST_EXACT commonest words are broadcast, the others' are
    joined to the documents that hold them. Words are told apart by 64-bit hashes, contexts by 32 bits of them.

    Null and empty texts are the end alone. Documents with a null id aren't held out. Rows that repeat an id are scored
    each. Other columns aren't looked at. An empty table gives no rows. The filter is never in one place: each block's
    n-grams are probed in the task that has their bucket's segment. The broadcast is 16 bytes a word of MOST_EXACT, at
    most.
    """
    blocks = _blocks(docs, id_col, text_col, F.coalesce(fold(id_col, folds) != held_out, F.lit(False)))
    table, found, _ = count(blocks)
    model, cut = commonest(table)
    uri = new_folder(docs.sparkSession, "levels")
    found.groupBy("block").applyInArrow(_put_levels(uri), "block long").agg(F.count("*")).collect()
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = written(blocks.drop("trained").mapInArrow(_scored(held, uri), _SCORED), "scored")
    rare = scored.filter(F.size("rare") > 0).select("id", "text_hash", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("id", "text_hash", F.col("x.rare").alias("h"), F.col("x.times").alias("n")).distinct()
    words = table.filter(F.col("gram") == UNIGRAM).select("hashes", "counts").mapInArrow(_spread, "h long, c long").filter((F.col("c") > 0) & (F.col("c") < cut))
    room = float(np.log10(model.total + model.distinct + 1.0))
    log = F.log10(F.coalesce("c", F.lit(0)) + 1.0) - F.lit(room)
    joined = rare.join(words, "h", "left").groupBy("id", "text_hash").agg(F.sum(F.col("n") * log).alias("rare_score"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"))
    out = scored.drop("rare", "times").join(joined, ["id", "text_hash"], "left").withColumn("doc_id", back("id"))
    return out.select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
        (F.col("score") / F.col("n_tokens")).alias("mean_score"),
    )
