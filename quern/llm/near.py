"""Near-duplicate groups: banded MinHash, Odd sketches for candidates, full shingle sets for links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, back, byte_column, ids, keep_keyed, key_of, mix, shingle_set, sliced, text_of, words_of, written

WIDTH = 5
#: A pair of similarity 0.85 shares none of 32 bands of 5 hashes with probability 7e-9, one of 0.8 with 3e-6.
BANDS, ROWS = 32, 5
#: One-permutation MinHash samples that the Odd sketch holds, one for each bin of the shingle hashes that isn't empty.
BINS = 1024
SKETCH_BITS = 1024
WORDS = SKETCH_BITS // 64
#: Deviations that a link's sketch may lie from what its similarity lets expect.
DEVIATIONS = 5.0
#: Documents on either side of a block task.
BLOCK = 384


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_ODD = _constants(BANDS * ROWS, 1) | np.uint64(1)
_ADD = _constants(BANDS * ROWS, 2)
_BAND = _constants(BANDS, 3)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions; long sets go in slices."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(low, (_ODD[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """Parity bitmap of the set's MinHash samples, and their number. The least hash of each bin of a sorted set is a sample."""
    bins = shingles >> np.uint64(64 - (BINS - 1).bit_length())
    samples = shingles[np.concatenate([[True], bins[1:] != bins[:-1]])]
    at = mix(samples + np.uint64(0x51ED270B)) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64), len(samples)


def sketch_difference(bits: float) -> float:
    """The number of samples in which two sets differ, from the number of bits in which their sketches do."""
    rest = 1 - 2 * bits / SKETCH_BITS
    return float("inf") if rest <= 0 else -SKETCH_BITS / 2 * float(np.log(rest))


def most_bits(samples: Column, percent: int) -> Column:
    """The bits in which the sketches of a link can plausibly differ; samples is the larger number of them.

    In a bin that isn't empty on both sides the samples agree with the similarity's probability; each that doesn't
    changes two samples at most.
    """
    miss = 1 - percent / 100
    bins = F.least(samples * (2 - percent / 100) + 10, F.lit(float(BINS)))
    differing = 2 * (bins * miss + DEVIATIONS * F.sqrt(bins * miss * (1 - miss)))
    return SKETCH_BITS / 2 * (1 - F.exp(differing * (-2 / SKETCH_BITS))) + 3 * DEVIATIONS


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = _BAND.copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + low.reshape(BANDS, ROWS)[:, r])
    return keys


_SIGNED = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("m", pa.int64()), *((f"s{i}", pa.int64()) for i in range(WORDS))])
SKETCH = [f"s{i}" for i in range(WORDS)]
SIGNED = "id long, key long, digest binary, n long, bands array<long>, m long, " + ", ".join(f"{c} long" for c in SKETCH)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, known = WordHashes(), {}
    for batch in sliced(batches):
        out: list[list] = [[] for _ in _SIGNED]
        for id_, key, raw in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), byte_column(batch, "text"), strict=True):
            words = words_of(raw)
            digest = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
            row = known.get(digest)
            if row is None:
                shingles = shingle_set(hashes.of(words), WIDTH)
                if len(shingles):
                    sketch, samples = odd_sketch(shingles)
                    row = (digest, len(shingles), band_keys(min_hashes(shingles)).view(np.int64), samples, *sketch.view(np.int64).tolist())
                else:
                    row = (None, 0, None, 0, *[None] * WORDS)
                if len(known) >= 4096:
                    known.clear()
                known[digest] = row
            for c, x in zip(out, (id_, key, *row), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SIGNED.types, strict=True)], schema=_SIGNED)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y| for sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Sets:
    """Shingle sets by node, computed once while they fit."""

    def __init__(self, most: int = 4_000_000):
        self.hashes, self.sets, self.most, self.held = WordHashes(), {}, most, 0

    def of(self, node: int, raw: bytes) -> np.ndarray:
        got = self.sets.get(node)
        if got is None:
            got = shingle_set(self.hashes.of(words_of(raw)), WIDTH)
            if self.held + len(got) > self.most:
                self.sets.clear()
                self.held = 0
            self.sets[node] = got
            self.held += len(got)
        return got


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            found = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), byte_column(batch, "ta"), byte_column(batch, "tb"), strict=True):
                if similar(sets.of(a, ta), shingle_set(sets.hashes.of(words_of(tb)), WIDTH), percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _candidates(table: pa.Table, percent: int) -> Iterator[np.ndarray]:
    """(bits, left row, right row) of a block pair's candidates: rows of different groups whose sketches are near enough
    and which share no earlier band than this bucket's."""
    group, side, m = (table.column(c).to_numpy() for c in ("group", "side", "m"))
    words = np.stack([table.column(c).to_numpy() for c in SKETCH], axis=1).view(np.uint64)
    bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(group), -1)
    bucket = table.column("bucket")[0].as_py()
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    miss = 1 - percent / 100
    for i in range(0, len(left), 64):
        at = left[i : i + 64]
        bits = np.bitwise_count(words[at, None, :] ^ words[None, right, :]).sum(axis=2, dtype=np.int64)
        bins = np.minimum(np.maximum(m[at, None], m[None, right]) * (1 + miss) + 10, BINS)
        differing = 2 * (bins * miss + DEVIATIONS * np.sqrt(bins * miss * (1 - miss)))
        most = SKETCH_BITS / 2 * (1 - np.exp(differing * (-2 / SKETCH_BITS))) + 3 * DEVIATIONS
        row, col = np.nonzero((bits <= most) & (group[at, None] != group[None, right]))
        a, b = at[row], right[col]
        if side[a[0]] == 0 if len(a) else False:  # one block against itself: each pair once
            keep = a < b
            a, b, row, col = a[keep], b[keep], row[keep], col[keep]
        shared = bands[a] == bands[b]
        first = bands[a, shared.argmax(axis=1)] == bucket
        yield np.stack([bits[row, col][first], a[first], b[first]], axis=1)


def _wanted(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """The rows of a block pair that have a candidate."""
        rows = [np.unique(x[:, 1:]) for x in _candidates(table, percent)]
        rows = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
        return table.select(["bucket", "i", "j", "node", "id", "key"]).take(pa.array(rows, pa.int64()))

    return run


def _joined(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """The links that join groups in a block pair, nearest candidates first; pairs joined already need no look."""
        node, group = table.column("node").to_pylist(), table.column("group").to_pylist()
        texts, sets, top = byte_column(table.combine_chunks().to_batches()[0], "text"), _Sets(), {g: g for g in group}

        def root(g: int) -> int:
            while top[g] != g:
                top[g] = top[top[g]]
                g = top[g]
            return g

        pairs = np.concatenate([np.empty((0, 3), np.int64), *_candidates(table, percent)])
        found = []
        for _, a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
            x, y = root(group[a]), root(group[b])
            if x != y and similar(sets.of(node[a], texts[a]), sets.of(node[b], texts[b]), percent):
                top[max(x, y)] = min(x, y)
                found.append((node[a], node[b]))
        return pa.table({k: pa.array([p[i] for p in found], pa.int64()) for i, k in enumerate("ab")})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, group) for every node of the links (a, b): group is the smallest node that can be reached.

    Large-star and small-star steps in turn. Each is a minimum per node, combined before the shuffle, and a join, so
    no node's neighbours have to fit in one task. The edges are written after each round.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    return edges.groupBy("u").agg(F.min("v").alias("group")).select(F.col("u").alias("node"), "group")


#: A class's row: its node, and the document that stands for it.
_WHO = ["node", "id", "key"]
_NODE = "node long, id long, key long"


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, key, text) for the documents (id, key) that are wanted, repeated rows once. The same plan at every size: texts
    cross one shuffle, by id and key, which serves the joins that follow."""
    some = texts.join(wanted.select("id", "key").distinct().hint("merge"), ["id", "key"], "left_semi")
    return some.dropDuplicates(["id", "key"])


#: Parts that the rows of one key are dealt to where a key may have a large part of all rows.
SALTS = 64


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).alias("salt")


def _salted_join(rows: DataFrame, asked: DataFrame, on: list[str], found: DataFrame) -> DataFrame:
    """rows, which have a salt, joined to found, which has a row a key. `asked` has the rows' keys and salts: found is repeated
    for each salt that its key has, SALTS times at most and no more often than there are rows."""
    keys = asked.select(*on, "salt").distinct()
    return rows.hint("merge").join(keys.join(found, on), [*on, "salt"])


def _star_links(buckets: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between each bucket's smallest node and its others, as a written table (a, b) of nodes."""
    pairs = buckets.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda x: sketches.select(*(F.col(c).alias(x + c) for c in sketches.columns))
    bits = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH)
    pairs = pairs.select(F.col("a").alias("a_node"), F.col("b").alias("b_node"), _salt("b"))
    near = _salted_join(pairs.join(side("b_").drop("b_bands"), "b_node"), pairs, ["a_node"], side("a_").drop("a_bands"))
    near = written(near.filter(bits <= most_bits(F.greatest("a_m", "b_m"), percent)).select(*(x + c for x in ("a_", "b_") for c in _WHO), "salt"), "pairs")
    ends = near.select(F.col("a_id").alias("id"), F.col("a_key").alias("key")).unionByName(near.select(F.col("b_id").alias("id"), F.col("b_key").alias("key")))
    some = _texts_of(ends, texts)
    end = lambda x: some.select(F.col("id").alias(f"{x}_id"), F.col("key").alias(f"{x}_key"), F.col("text").alias(f"t{x}"))
    rows = _salted_join(near.hint("merge").join(end("b"), ["b_id", "b_key"]), near, ["a_id", "a_key"], end("a"))
    rows = rows.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "ta", "tb")
    return written(rows.mapInArrow(_verify(percent), "a long, b long"), "links")


def _dealt(buckets: DataFrame, groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of buckets whose nodes aren't one component yet, dealt to pairs of blocks (bucket, i, j) as a written table.

    A bucket of up to BLOCK nodes is one block. In a larger one, nodes are first put into classes by the logarithm of their
    sets' sizes, a link's ratio wide: a link's ends are in one class or in neighbouring ones, so only blocks of those meet.
    And the nodes of the bucket's largest component are apart from the rest: they meet the rest only, since what is one
    component already needs no pairs. So a component that is most of a bucket costs a row a node, not one for each block.
    Blocks are numbered (cell << 32 | place), a cell being twice the class plus 1 for the largest component; a bucket has
    fewer than 280 cells, so its list of them is short.
    """
    step = float(np.log(100 / percent)) + 1e-9
    placed = buckets.filter("size > 2").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    counts = placed.filter(F.col("size") > BLOCK).groupBy("bucket", "group").agg(F.count("*").alias("n"))
    # written, so that the planner sees its size: it is broadcast only if that is small, and otherwise hot buckets are split
    largest = written(counts.groupBy("bucket").agg(F.max_by("group", F.struct("n", "group")).alias("largest")), "largest")
    kind = F.when(F.col("size") > BLOCK, F.floor(F.log("n") / step)).otherwise(0).cast("long")
    cell = 2 * kind + F.coalesce((F.col("group") == F.col("largest")).cast("long"), F.lit(0))
    placed = placed.join(largest, "bucket", "left").select("bucket", "node", "group", cell.alias("cell"))
    cells = placed.groupBy("bucket", "cell").agg(F.count("*").alias("size"), F.min("group").alias("low"), F.max("group").alias("high"))
    listed = F.map_from_entries(F.collect_list(F.struct("cell", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))))
    mixed = written(cells.groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"), listed.alias("cells")).filter("low != high").select("bucket", "cells"), "mixed")

    number = lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(0).cast("long"))
    name = lambda c, at: F.shiftleft(c, 32).bitwiseOR(at)
    mine = name(F.col("cell"), F.pmod(F.xxhash64("node"), number(F.col("cell"))))

    def blocks(c: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), number(c)), lambda m: m < number(c)), lambda m: name(c, m))

    apart = F.col("cell") % 2 == 1
    rest, none = F.col("cell") - F.col("cell") % 2, F.array().cast("array<long>")
    others = [blocks(rest + 2 * d) for d in (-1, 0, 1)] + [F.when(apart, none).otherwise(blocks(rest + 2 * d + 1)) for d in (-1, 0, 1)]
    dealt = placed.join(mixed, "bucket").withColumn("mine", mine).withColumn("other", F.explode(F.concat(*others)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "node", "group")
    return written(dealt.join(sketches, "node"), "open")


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """id, key, n, component (an id) and kept for each row of docs; see near_dedup."""
    texts = docs.select(ids(id_col).alias("id"), key_of(text_col).alias("key"), text_of(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign, SIGNED), "signed")
    # the document that stands for a class comes with its bands and sketch, so copies meet in each task before the shuffle;
    # a node's number follows the order of (id, key), so the smallest node of a component has its smallest id
    classes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "key", "n", "m", "bands", *SKETCH)).alias("rep"))
    classes = classes.select("digest", "rep.*").sort("id", "key").withColumn("node", F.monotonically_increasing_id())
    classes = written(classes.select("digest", *_WHO, "n", "m", "bands", *SKETCH), "classes")
    sketches = classes.drop("digest", "n")

    banded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    buckets = written(banded.join(shared, "bucket"), "buckets")

    links = _star_links(buckets, sketches, texts, percent)
    groups = components(links)
    dealt = _dealt(buckets, groups, sketches, percent)
    wanted = written(dealt.groupBy("bucket", "i", "j").applyInArrow(_wanted(percent), f"bucket long, i long, j long, {_NODE}"), "wanted")
    if not wanted.isEmpty():
        rows = dealt.join(wanted.select("bucket", "i", "j", "node"), ["bucket", "i", "j", "node"], "left_semi")
        rows = rows.hint("merge").join(_texts_of(wanted, texts), ["id", "key"])
        more = rows.groupBy("bucket", "i", "j").applyInArrow(_joined(percent), "a long, b long")
        groups = components(links.unionByName(written(more, "links")))

    groups = groups.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    least = classes.select(F.col("node").alias("group"), F.col("id").alias("least"))
    groups = _salted_join(groups, groups, ["group"], least).select("node", "group", "least")
    named = classes.select("digest", *_WHO).join(groups, "node", "left")
    named = written(named.select("digest", F.col("id").alias("rep_id"), F.col("key").alias("rep_key"), F.coalesce("least", "id").alias("component"), (F.coalesce("group", "node") == F.col("node")).alias("first")), "named")
    rows = signed.filter("digest IS NOT NULL").select("id", "key", "n", "digest", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).alias("salt"))
    out = _salted_join(rows, rows, ["digest"], named)
    stands = F.col("first") & (F.col("id") == F.col("rep_id")) & (F.col("key") == F.col("rep_key"))
    out = out.select("id", "key", "n", "component", stands.alias("kept"))
    alone = signed.filter("digest IS NULL").select("id", "key", "n", F.col("id").alias("component"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links are pairs with 100 * |A & B| >= percent * |A | B|.

    Texts with the same words share one class, which the document with the smallest id stands for. Classes are banded by
    MinHash. First each bucket's smallest node is held against the others, which joins most groups at a pair per document.
    In buckets whose nodes aren't one component then, all pairs of different components are gone through, in blocks and
    within a task, so that pairs never become rows. Pairs whose Odd sketches differ in more bits than a link plausibly can
    are left out; the others are confirmed on their full shingle sets.

    Null and empty texts, and those of white space, have no shingles and link with nothing, not even each other. Rows are
    told apart by their id and text: several rows without an id, or with one id and different texts, are documents of their
    own, and only rows that repeat both are one. A null id counts as the smallest; component_id is null where it is the
    smallest. kept holds for the document that stands for the component, and for rows that repeat it. Other columns aren't
    looked at. An empty table gives no rows.
    """
    out = _grouped(docs, id_col, text_col, percent)
    return out.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), "kept")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents that stand for their group, columns as they were; documents are told apart as by near_dedup.

    A filter of a corpus takes a similarity of 0.8 or more as a copy, unless the caller says otherwise.
    """
    return keep_keyed(docs, _grouped(docs, id_col, text_col, percent).filter("kept"), id_col, text_col)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a AS f, b AS t FROM l UNION SELECT b, a FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.t FROM r JOIN e ON e.f = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(r.node) AS component_id, n.doc_id = min(r.node) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
