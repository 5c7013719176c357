"""Each corpus operator against a plain version, and on the odd cases that its docstring defines."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import decontam, exact, language, lm, near, packing, quality, queries, token_ids, urls, warc
from quern.llm.common import NULL_ID, CachedEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def load(spark, smoke, name):
    return spark.read.parquet(f"{smoke}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and white texts, ties, a repeated row, a long text, a clashing column."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat and then it slept for hours.", "en", "s", 1),
        (2, "the CAT sat on the mat and then it slept for hours.", "en", "s", 1),
        (2, "the CAT sat on the mat and then it slept for hours.", "en", "s", 1),
        (3, "The cat sat on the mat and then it slept for hours.", None, None, None),
        (4, None, "en", "s", None),
        (5, "", "fr", None, 0),
        (6, " \n\t ", "fr", "s", 3),
        (7, "one two", "en", "s", 7),
        (None, "one two", "en", "s", 7),
        (8, "12345 67890 !!", "de", "s", 14),
        (9, long, "en", "s", len(long)),
        (10, long + " tail", "en", "s", len(long) + 5),
        (11, "Der Hund und die Katze sind im Haus und schlafen sehr lange.", "de", "s", 60),
        (12, "Ünïcode — “quotes” 中文 text 🙂 end", "de", "s", 30),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({"component_id": F.lit("x"), "id": F.lit("y"), "kept": F.lit("z"), "score": F.lit("q"), "n_tokens": F.lit("w")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, percent=85):
    where, sets = defaultdict(set), {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for x in sets[i]:
            where[x].add(i)
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_equals_brute_force_on_the_table(spark, smoke):
    docs = load(spark, smoke, "documents")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_near_dedup(spark, smoke).collect()}
    assert got == want


def test_near_chains_and_large_groups(spark):
    """A chain whose ends aren't similar, a group of many near copies of a base, and a passage that unlike texts share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows, n = [], 0
    base = [word() for _ in range(120)]
    for _ in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        copy[rng.randrange(120)] = word()
        rows.append((n, " ".join(copy)))
        n += 1
    link = [word() for _ in range(100)]
    for _ in range(12):
        link = link[2:] + [word(), word()]
        rows.append((n, " ".join(link)))
        n += 1
    passage = [word() for _ in range(60)]
    for _ in range(150):
        rows.append((n, " ".join([word() for _ in range(40)] + passage)))
        n += 1
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_odd_cases(odd, empty):
    got = {r.doc_id: r for r in near.near_dedup(odd).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 1] and got[1].kept and not got[3].kept
    assert all(got[i].component_id == i and got[i].n_shingles == 0 and got[i].kept for i in (4, 5, 6))
    assert got[None].component_id is None and got[None].kept and got[7].component_id is None and not got[7].kept
    assert got[10].component_id == 9 and near.near_dedup(odd).count() == odd.count()
    assert near.near_dedup(empty).count() == 0
    kept = near.keep_one_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, None, 8, 9, 11, 12}


def test_odd_sketch_estimates_difference():
    rng = np.random.default_rng(1)
    for share in (0.95, 0.9, 0.85):
        whole = rng.integers(0, 2**64, 2000, dtype=np.uint64)
        cut = int(2000 * (1 + share) / 2)
        a, b = np.unique(whole[:cut]), np.unique(whole[2000 - cut :])
        (x, m), (y, n) = near.odd_sketch(a), near.odd_sketch(b)
        bits = int(np.bitwise_count(x ^ y).sum())
        real = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        got = near.sketch_difference(bits) * real / max(1, real)
        assert 0 < m <= near.BINS and 0 < n <= near.BINS
        assert got == pytest.approx(2 * (1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) * 880, rel=0.35)


# ---------------------------------------------------------------- packing and token ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoder_is_the_library(path):
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "don't", "it.'s", "\xa0", "x1", "!!", "<|endoftext|>", "ß", "Σ", "İ", "\x1c", "\x85", "中", "🙂", "Word", "<", "|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    e = CachedEncoder(path, limit=200)
    want = [np.asarray(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [e.ids_of(t) for t in texts] == want


def check_pieces(rows, full):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, ids in full.items():
        at = 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding, sum(map(len, full.values()))


def test_packing_covers_every_id_once(spark, smoke):
    t = Tokenizer.from_file(WORD)
    full = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in load(spark, smoke, "documents").collect()}
    padding, total = check_pieces(queries.op2_packing(spark, smoke).collect(), full)
    assert padding <= 0.005 * total


def test_packing_odd_cases(odd, empty):
    rows = packing.pack(odd, WORD).collect()
    assert {r.doc_id: r.length for r in rows if r.doc_id in (4, 5)} == {4: 1, 5: 1}
    assert sum(r.doc_id == 2 and r.start == 0 for r in rows) == 2
    assert packing.pack(empty, WORD).count() == 0


def test_sum_of_squares_keeps_its_level_array():
    rng = random.Random(3)
    p, out = packing.SumOfSquares(64, most_open=20), []
    sizes = [rng.randint(1, 150) for _ in range(2000)]
    for i, n in enumerate(sizes):
        out += list(p.place(packing.Piece(i, 0, bytes(4 * n), n)))
        assert p.open == p.counts.sum() == sum(map(len, p.levels.values())) and p.open <= 20
    assert all(sum(map(len, w)) == 64 for w in out)
    out += list(p.finish())
    assert Counter({i: n for i, n in enumerate(sizes)}) == sum((Counter({x.id: len(x)}) for w in out for x in w), Counter())


def test_token_ids_round_trip(spark, smoke):
    t, start, want = Tokenizer.from_file(BYTE), 0, {}
    for r in sorted(load(spark, smoke, "documents").collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_ids(spark, smoke).collect()} == want


def test_token_ids_odd_cases(odd, empty):
    rows = token_ids.encode_and_read(odd, BYTE).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.n_tokens for r in rows if r.doc_id in (4, 5)} == {4: 1, 5: 1}
    assert next(r for r in rows if r.doc_id is None).start == 0
    assert token_ids.encode_and_read(empty, BYTE).count() == 0


def test_levels_read_any_id():
    rng = np.random.default_rng(4)
    for values in (np.empty(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 2**32, 3000), rng.integers(0, 200, 2000), rng.integers(0, 60_000, 9000)):
        x = token_ids.Levels.of(values)
        assert [x.get(i) for i in range(0, len(values), 7)] == values[::7].tolist()
        for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2)):
            assert x.slice(a, b).tolist() == values[a:b].tolist()
    ids, starts, levels = token_ids.from_bytes(token_ids.to_bytes(np.array([3, 9]), np.array([2, 1]), np.array([70_000, 1, 5])))
    assert (ids.tolist(), starts.tolist(), levels.slice(0, 3).tolist()) == ([3, 9], [0, 2, 3], [70_000, 1, 5])


# ---------------------------------------------------------------- exact copies


def test_cuckoo_index_against_a_dict():
    rng = random.Random(6)
    index, want = exact.CuckooIndex(2), {}
    for _ in range(20_000):
        d = rng.randrange(3000).to_bytes(4, "big") * 8
        if rng.random() < 0.3:
            assert index.delete(d) == (want.pop(d, None) is not None)
        else:
            i = rng.randrange(1000)
            assert index.insert(d, i) == (d not in want)
            old = want.get(d, (-1, 0))
            want[d] = (max(i, old[0]), old[1] + 1)
    assert {k: (i, n) for k, i, n in index.items()} == want and len(index) == len(want) and index.resizes
    assert all(index.get(k) == v for k, v in want.items()) and index.get(b"x" * 32) is None


def test_update_index(spark):
    old = spark.createDataFrame([(b"a" * 32, 1, 2), (b"b" * 32, 2, 1)], exact.INDEX_SCHEMA)
    new = exact.update_index(old, spark.createDataFrame([(b"b" * 32, 9, 1), (b"c" * 32, 3, 1)], exact.INDEX_SCHEMA), spark.createDataFrame([(b"a" * 32,)], "digest binary"), 3)
    assert {bytes(r.digest)[:1]: (r.keep_id, r.group_size) for r in new.collect()} == {b"b": (9, 2), b"c": (3, 1)}


def test_exact_odd_cases(odd, empty):
    got = defaultdict(list)
    for r in exact.exact_dedup(odd).collect():
        got[r.doc_id].append(r)
    assert (got[1][0].keep_id, got[1][0].group_size, got[1][0].kept, got[3][0].kept) == (3, 2, False, True)
    assert len(got[2]) == 2 and all(r.kept and r.group_size == 2 for r in got[2])
    assert got[4][0].keep_id == 5 and got[7][0].keep_id == 7 and got[None][0].keep_id == 7 and not got[None][0].kept
    assert exact.exact_dedup(empty).count() == 0
    kept = exact.keep_first_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9, 10, 11, 12]


# ---------------------------------------------------------------- decontamination


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_matcher_equals_brute_force(spark, smoke):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in load(spark, smoke, "benchmark").limit(5).collect()]
    texts = [r.text for r in load(spark, smoke, "documents").limit(40).collect()]
    m, hits = decontam.Matcher(items), 0
    for k in range(60):
        i, t = rng.choice(items)
        s = list(t)
        for _ in range(rng.randint(0, 40)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["a", "e ", "x", ""])
        doc = texts[k % 40][:200] + " " + "".join(s) + " " + texts[(k + 1) % 40][:100]
        got = dict(m.find(doc))
        for i, t in items:
            p = decontam.normal(t)
            d = brute_distance(p, decontam.normal(doc))
            assert (i in got) == (d <= decontam.budget(len(p)))
            hits += i in got
            assert i not in got or got[i] == d
    assert hits > 10


def test_decontamination_of_the_table(spark, smoke):
    items = [(r.item_id, decontam.normal(r.text)) for r in load(spark, smoke, "benchmark").collect()]
    docs = load(spark, smoke, "documents").collect()
    got = {r.doc_id: set(r.item_ids) for r in queries.op6_decontamination(spark, smoke).collect()}
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        assert {i for i, t in items if t in decontam.normal(d.text or "")} <= got[d.doc_id]


def test_decontamination_odd_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, "THE cat sat on the mat and then it slept"), (2, None), (3, ""), (None, "Der Hund und die Katze sind im Haus")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(odd, items).collect()}
    assert got[1].item_ids == [1] and got[3].contaminated and got[11].contaminated and not got[4].contaminated and not got[9].contaminated
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(odd, items.limit(0)).filter("contaminated").count() == 0
    kept = decontam.keep_clean(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, None, 8, 9, 10, 12}


def test_passes_over_the_items_agree(spark, smoke, monkeypatch):
    docs, items = load(spark, smoke, "documents"), load(spark, smoke, "benchmark")
    one = sorted((r.doc_id, r.item_id, r.edits) for r in decontam.find_items(docs, items).collect())
    monkeypatch.setattr(decontam, "PASS_CHARS", 2000)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontam.find_items(docs, items).collect()) == one


# ---------------------------------------------------------------- language, quality, language model


def test_language_accuracy(spark, smoke):
    lang = {r.doc_id: r.lang for r in load(spark, smoke, "documents").collect()}
    rows = queries.op7_language(spark, smoke).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_mixture_and_odd_cases(spark, smoke, odd, empty):
    docs = load(spark, smoke, "documents")
    model = language.train(docs)
    part = {r.lang: r.text for r in docs.filter("n_chars BETWEEN 1500 AND 4000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    _, share, mix = model.judge(part["fr"][:1200] + " " + part["de"][:600])
    assert {x for x, _ in mix} == {"fr", "de"} and mix[0][0] == "fr" and 0.5 < share < 0.8
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 8)) and got[1].lang_pred in ("en", "de", "fr")
    assert [len(language.letters(x)) > 0 for x in ("🙂 12", "𝒳", "中", "é", "")] == [False, True, True, True, False]
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and not {4, 5, 6, 8} & {r.doc_id for r in kept.collect()}


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in load(spark, sf, "labels").collect()}
    held = [r for r in queries.op3_quality(spark, sf).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held)
    bad = [r.score for r in held if not label[r.doc_id]]
    good = [r.score for r in held if label[r.doc_id]]
    assert sum(a > b for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_quality_odd_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, 0), (11, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def test_lm_base_is_exact_and_model_is_better(spark, smoke, monkeypatch):
    docs = {r.doc_id: r.text for r in load(spark, smoke, "documents").collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    results = []
    for most in (lm.MOST_EXACT, 500):  # the second leaves most words to the join
        monkeypatch.setattr(lm, "MOST_EXACT", most)
        rows = queries.op4_lm_score(spark, smoke).collect()
        for r in rows:
            t = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        results.append(sum(r.score for r in rows))
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    assert results[0] == results[1]


def test_lm_filter_counts(spark, smoke):
    model, _, _ = lm.fit(load(spark, smoke, "documents"))
    counts = Counter(w for r in load(spark, smoke, "documents").collect() for w in (r.text or "").encode().lower().split())
    words = list(counts)
    got = model.counts(lm._Tokens().hashes.of(words), lm.UNIGRAM)
    close = [abs(a - counts[w]) <= 0.06 * counts[w] + 1e-9 for a, w in zip(got, words, strict=True)]
    assert np.mean(close) > 0.99
    none = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    assert (model.counts(none, lm.UNIGRAM) > 0).mean() < 0.02


def test_lm_probabilities_add_up(spark, smoke):
    """After some word, the model's probabilities of all known words and one unknown add up to about 1."""
    model, _, _ = lm.fit(load(spark, smoke, "documents"))
    words = np.unique(np.concatenate([lm._Tokens().of((r.text or "").encode()) for r in load(spark, smoke, "documents").collect()]))
    for before in (b"the", b"de", b"of"):
        u = lm._Tokens().hashes.of([before])
        one, seen = model.counts(u, lm.UNIGRAM)[0], model.counts(lm.context_key(lm.context_of(u)), lm.SEEN)[0]
        both = model.counts(lm.bigrams(np.repeat(u, len(words)), words), lm.BIGRAM)
        ones = model.counts(words, lm.UNIGRAM)
        single = (ones + 1) / (model.total + model.distinct + 1)
        total = lm.probability(np.full(len(words), one), np.full(len(words), seen), both, ones, single).sum()
        assert 0.99 <= total <= 1.001


def test_lm_filter_keeps_its_lowest_levels(spark, smoke, monkeypatch):
    """A bound on the filter's size, which there was, must not make rarer n-grams read as unseen."""
    docs = load(spark, smoke, "documents")
    whole = sorted((r.doc_id, r.score) for r in lm.score_lm(docs).collect())
    monkeypatch.setattr(lm, "MOST_FILTER_BYTES", 4_000, raising=False)
    assert sorted((r.doc_id, r.score) for r in lm.score_lm(docs).collect()) == whole
    model, _, _ = lm.fit(docs)
    counts = Counter(w for r in docs.collect() for w in (r.text or "").encode().lower().split())
    words = lm._Tokens().hashes.of(list(counts))
    assert (model.counts(words, lm.UNIGRAM) > 0).all() and (model.counts(lm.context_key(lm.context_of(words)), lm.SEEN) > 0).any()


def test_lm_keeps_bigrams_seen_once(spark):
    docs = spark.createDataFrame([(1, "red fox runs home"), (2, "blue fox sits")], "doc_id long, text string")
    model, _, _ = lm.fit(docs)
    red, blue, fox, runs, sits = lm._Tokens().hashes.of([b"red", b"blue", b"fox", b"runs", b"sits"])
    before, words = np.array([red, fox, fox, red]), np.array([fox, runs, sits, sits])
    assert model.counts(lm.bigrams(before, words), lm.BIGRAM).tolist() == [1, 1, 1, 0]
    assert model.counts(lm.context_key(lm.context_of(np.array([red, blue, fox]))), lm.SEEN).tolist() == [0.25, 0.25, 0.5]


def test_lm_odd_cases(odd, empty):
    rows = lm.score_lm(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and got[4].n_tokens == got[5].n_tokens == got[6].n_tokens == 1 and got[2].n_tokens == got[1].n_tokens == 13
    assert lm.score_lm(empty).count() == 0


# ---------------------------------------------------------------- pages


def test_urls_odd_cases(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?y#z"), (4, "https://example.com/de/"), (5, "http://x.net"), (6, "http://b.org/fr/a://b"), (7, "http://bad.org/x"), (7, "http://bad.org/x"), (None, "http://bad.org?q"), (8, "http://good.org#f"), (9, "http://notexample.com/de/1")], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit(1), "rule": F.lit(2), "mean": F.lit(3), "suffix": F.lit(4)})
    outcomes = spark.createDataFrame([(7, 1)] * 60 + [(8, 0)] * 60 + [(None, 1)], "id long, bad int")
    got = {r.page_id: r for r in urls.judge(pages, outcomes).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow") and got[2].host == ""
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("example.com/de/", "block") and got[5].rule is None and got[5].path == ""
    assert (got[6].rule, got[6].path) == ("org/fr/", "/fr/a://b") and got[9].rule is None
    assert got[7].verdict == "block" and got[None].verdict == "block" and got[8].verdict == "allow" and got[8].path == ""
    assert urls.judge(pages.limit(0), outcomes).count() == 0
    assert urls.judge(pages, outcomes.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0


def test_urls_hosts_without_labels_are_judged_by_the_level_above(spark):
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(["a.bad.org", "b.bad.org", "new.bad.org", "a.good.com", "new.good.com", "other.edu"])], "page_id long, url string")
    outcomes = spark.createDataFrame([(0, 1), (1, 1)] * 200 + [(3, 0)] * 400, "id long, bad int")
    got = {r.host: r for r in urls.judge(pages, outcomes).collect()}
    assert len(got) == 6 and got["new.bad.org"].verdict == "block" and got["new.bad.org"].bad_rate > 0.9
    assert [got[h].verdict for h in ("a.bad.org", "a.good.com", "new.good.com", "other.edu")] == ["block", "allow", "allow", "allow"]


def test_warc_records(spark):
    import base64
    import hashlib

    html = [None, "", "<p>a</p>", "<p>a</p>", "ü" * 50_000, "x"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", h) for i, h in enumerate(html)] + [(2, None, "<p>a</p>"), (None, "u", "x")], "page_id long, url string, html string").withColumn("sha", F.lit(0))
    rows = warc.archive_and_read(pages).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 8
    for i, h in enumerate(html):
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert [(got[i].record_type, got[i].refers_to) for i in range(4)] == [("response", None), ("revisit", 0), ("response", None), ("revisit", 2)]
    assert got[None].record_type == "response" and got[5].record_type == "revisit" and got[5].refers_to is None
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    assert warc.archive_and_read(pages, least_bytes=5).filter("record_type = 'revisit'").count() == 1


def test_archive_leads_with_its_dictionary():
    records = [warc.record(i, f"http://h/{i}", (f"<html><body><p>page {i} of many</p>" + "<div>same frame</div>" * 20).encode() * 3, "0" * 40, i) for i in range(200)]
    raw = warc.to_archive(records)
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME and int.from_bytes(raw[4:8], "little") > 0
    assert list(warc.from_archive(raw)) == records and warc.parse(records[3])["payload"].startswith(b"<html>")
    assert list(warc.from_archive(warc.to_archive(records[:2]))) == records[:2]


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_against_plain_versions(spark, smoke):
    import corpus_pipeline

    docs = load(spark, smoke, "documents")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    items = [decontam.normal(r.text) for r in load(spark, smoke, "benchmark").collect()]
    state = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "decontamination", "packing"]
    state = stages["language"](spark, docs, smoke)
    kept = {r.doc_id for r in state.collect()}
    assert state.columns == docs.columns and kept >= {i for i, t in rows.items() if len(t) > 200}
    state = stages["exact"](spark, state, smoke)
    last = {rows[i]: i for i in sorted(kept)}
    assert {r.doc_id for r in state.collect()} == set(last.values())
    state = stages["near"](spark, state, smoke)
    comp = brute_components([(i, rows[i]) for i in last.values()], 80)
    kept = {r.doc_id for r in state.collect()}
    assert kept == {i for i, (_, c) in comp.items() if i == c}
    state = stages["decontamination"](spark, state, smoke)
    clean = {r.doc_id for r in state.collect()}
    assert clean <= kept and {i for i in kept if any(t in decontam.normal(rows[i]) for t in items)} == kept - clean
    t = Tokenizer.from_file(WORD)
    full = {i: np.array([*t.encode(rows[i], add_special_tokens=False).ids, 2], "<u4") for i in clean}
    check_pieces(stages["packing"](spark, state, smoke).collect(), full)
    assert {r.doc_id for r in corpus_pipeline.run(spark, smoke).collect()} == clean


def test_null_id_value():
    assert NULL_ID == -(2**63)
