"""Rows without an id, ids with several texts, clashing columns, skewed groups and bounded memory."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import common, decontam, exact, language, lm, near, quality, queries, token_ids, urls, warc
from quern.sources import tables
from tests.llm.test_ops import brute_components, brute_distance, load

TWICE = "doc_id long, text string, lang string, __id string, __sha int"


@pytest.fixture(scope="module")
def twice(spark):
    """Two rows without an id, one id with two texts, a row repeated, columns named as helpers once were."""
    a = "the quick brown fox jumps over the lazy dog while the cat sleeps on a warm mat near the old stove in winter"
    rows = [
        (None, a, "en", "p", 1),
        (None, "a benchmark question about the capital city of a far country", "en", "q", 2),
        (5, "completely different words stand here and nothing else is shared with other rows at all", "en", "r", 3),
        (5, a + " again", "en", "s", 4),
        (7, a, "en", "t", 5),
        (7, a, "en", "t", 5),
        (8, None, "en", "u", 6),
        (None, "123", "en", "v", 7),
    ]
    return spark.createDataFrame(rows, TWICE)


def marks(df):
    return sorted(r["__id"] for r in df.collect())


def test_filters_decide_row_by_row(spark, twice):
    items = spark.createDataFrame([(1, "A benchmark question about the capital city")], "item_id long, text string")
    clean = decontam.keep_clean(twice, items)
    assert clean.columns == twice.columns and marks(clean) == ["p", "r", "s", "t", "t", "u", "v"]
    got = [(r.doc_id, r.contaminated) for r in decontam.decontaminate(twice, items).collect()]
    assert sorted(got, key=str) == sorted([(None, False), (None, True), (5, False), (5, False), (7, False), (7, False), (8, False), (None, False)], key=str)
    known = language.keep_identified(twice)
    assert known.columns == twice.columns and marks(known) == ["p", "q", "r", "s", "t", "t"]


def test_copies_are_told_apart_by_id_and_text(twice):
    kept = exact.keep_first_copies(twice)
    assert kept.columns == twice.columns and marks(kept) == ["q", "r", "s", "t", "u", "v"]
    rows = {(r.doc_id, r.n_shingles): r for r in near.near_dedup(twice, percent=80).collect()}
    assert rows[(5, 20)].component_id is None and not rows[(5, 20)].kept and rows[(7, 19)].component_id is None
    assert rows[(5, 11)].component_id == 5 and rows[(5, 11)].kept
    assert rows[(None, 19)].kept and rows[(None, 7)].kept and rows[(None, 7)].component_id is None
    near_kept = near.keep_one_each(twice)
    assert near_kept.columns == twice.columns and marks(near_kept) == ["p", "q", "r", "u", "v"]


def test_a_link_to_the_second_text_of_an_id(spark):
    words = [f"w{i}" for i in range(14)]
    docs = spark.createDataFrame([(5, "other things entirely are said in this text here"), (5, " ".join(words)), (7, " ".join(words + ["more"]))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_dedup(docs, percent=70).collect())
    assert got == [(5, 5, 5, True), (5, 10, 5, True), (7, 11, 5, False)]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Buckets of many blocks, with sizes in several classes: all links that brute force finds."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng, rows, n = random.Random(11), [], 0
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    passage = [word() for _ in range(150)]
    for _ in range(60):  # texts that share most of a passage, of several lengths, and a near copy of each third
        own = [word() for _ in range(rng.choice((20, 30, 60)))]
        rows.append((n, " ".join(passage + own)))
        n += 1
        if n % 3 == 0:
            own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(passage + own)))
            n += 1
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_recall_at_the_threshold():
    """Pairs just above the threshold share a band: measured misses of 20,000 made pairs against those expected, 1e-4 of one."""
    rng, misses = np.random.default_rng(3), 0
    for _ in range(400):
        whole = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        a, b = np.unique(whole[:925]), np.unique(whole[75:])  # 850 of 1000
        misses += not np.any(near.band_keys(near.min_hashes(a)) == near.band_keys(near.min_hashes(b)))
    assert misses == 0


def test_exact_copies_of_one_content(spark, monkeypatch):
    index = exact.CuckooIndex()
    assert index.insert(b"d" * 32, 1, 1, "text") and not index.insert(b"d" * 32, 2, 1, "text") and index.verified == 1
    with pytest.raises(ValueError, match="two contents"):
        index.insert(b"d" * 32, 3, 1, "other")
    monkeypatch.setattr(exact, "MOST_CHARS", 100)
    monkeypatch.setattr(exact, "MOST_LIVE", 5)
    rows = [(i, f"text number {i % 40} " * (1 + i % 3)) for i in range(400)] + [(1000 + i, "hot") for i in range(200)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_least_edits_over_the_whole_text():
    item = "the answer to the question is that the river runs north in spring"
    m = decontam.Matcher([(1, item)])
    worse, better = item.replace("river", "rixyr"), item.replace("river", "rivor")
    assert m.find(f"some text {worse} then {better} end") == [(1, 1)]
    assert m.find(f"{worse} {worse}") == [(1, brute_distance(item, worse))]


def test_long_words_and_pieces_are_not_held():
    hashes, encoder = common.WordHashes(), common.CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(300):
        text = chr(0x4E00 + i) * 500
        hashes.of([text.encode()])
        encoder.ids_of(text)
    assert not hashes and not encoder.initial and not encoder.inner
    small = common.CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), limit=40_000)
    for i in range(2000):
        small.ids_of(f"word{i} other{i}")
    assert len(small.inner) + len(small.inner.old) < 200


def test_lm_score_equals_brute_force(spark, smoke, monkeypatch):
    """With so large a filter that no membership is false, each score follows from the quantised counts."""
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 64)
    docs = {r.doc_id: r.text for r in load(spark, smoke, "documents").collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    ones = Counter(w for t in train for w in t)
    twos = Counter(p for t in train for p in zip([None, *t[:-1]], t))
    seen = Counter()
    for (u, _), c in twos.items():
        seen[u] += c - lm.DISCOUNT
    n, v = sum(ones.values()), len(ones)
    held = lambda c, kind: float(lm.count_at(lm.levels(np.array([c]), kind), kind)[0])
    c1 = {w: held(c, lm.UNIGRAM) for w, c in ones.items()}
    c2 = {p: held(c, lm.BIGRAM) for p, c in twos.items()}
    cs = {u: held(round(4 * s), lm.SEEN) for u, s in seen.items()}
    want = {}
    for i, t in tokens.items():
        total = 0.0
        for u, w in zip([None, *t[:-1]], t):
            s = cs.get(u, 0.0)
            both = min(c2.get((u, w), 0.0), c1.get(w, 0.0), s + lm.DISCOUNT)
            known = (1 - lm.LEAST_UNIGRAM) / max(c1.get(u, 0.0), s, 1.0)
            total += math.log10(known * max(0.0, both - lm.DISCOUNT) + (1 - known * s) * (c1.get(w, 0.0) + 1) / (n + v + 1))
        want[i] = total
    got = {r.doc_id: r.score for r in lm.score_lm(load(spark, smoke, "documents")).collect()}
    assert got == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}


def test_lm_scores_do_not_depend_on_block_or_bucket_sizes(spark, smoke, monkeypatch):
    docs = load(spark, smoke, "documents")
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 64)
    want = sorted((r.doc_id, r.score, r.base_score) for r in lm.score_lm(docs).collect())
    monkeypatch.setattr(lm, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(lm, "BLOCKS_A_BUCKET", 1)
    got = sorted((r.doc_id, r.score, r.base_score) for r in lm.score_lm(docs.select("*", F.lit(1).alias("block"))).collect())
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1:] for x in got] == [pytest.approx(x[1:], rel=1e-12) for x in want]


def test_every_archive_has_a_dictionary_and_payloads_are_checked():
    rng = random.Random(2)
    for records in ([b"x"], [b"one record of some length " * 3], [rng.randbytes(300_000)], [bytes([i]) * 70_000 for i in range(40)], [rng.randbytes(50) for _ in range(2000)]):
        raw = warc.to_archive(records)
        assert int.from_bytes(raw[4:8], "little") > 0 and list(warc.from_archive(raw)) == records
    good = warc.record(3, "http://h/3", b"<p>body</p>", hashlib.sha1(b"<p>body</p>").hexdigest(), 3)
    assert warc.checked(warc.parse(good))["payload_bytes"] == 11
    with pytest.raises(ValueError, match="page 3"):
        warc.checked(warc.parse(good.replace(b"body", b"BODY")))


def test_the_archive_reader_is_linear():
    def seconds(n):
        raw = warc.to_archive([b"record number %d of an archive" % i for i in range(n)])
        best = []
        for _ in range(3):
            t = time.perf_counter()
            assert sum(1 for _ in warc.from_archive(raw)) == n
            best.append(time.perf_counter() - t)
        return min(best)

    assert seconds(16_000) < 12 * seconds(4_000)


def test_beta_tail_against_integration(spark):
    """The tail of beta distributions with small and large weights, by a fine sum over the rate itself."""
    cases = [(0.9, 1.0), (0.6, 3.0), (0.7, 40.0), (0.52, 500.0), (0.501, 200_000.0), (0.3, 7.0), (0.05, 2.0), (0.97, 1000.0)]
    got = [r.t for r in spark.createDataFrame(cases, "m double, w double").select(urls.tail(F.col("m"), F.col("w")).alias("t")).collect()]
    t = np.linspace(-400, 400, 4_000_001)
    low, high = -np.logaddexp(0, -t), -np.logaddexp(0, t)
    for (m, w), x in zip(cases, got, strict=True):
        f = m * w * low + (1 - m) * w * high
        f = np.exp(f - f.max())
        assert x == pytest.approx((f[:2_000_000].sum() + f[2_000_000] / 2) / f.sum(), rel=5e-4, abs=1e-9)  # the plain sum is that coarse at the largest weight


def test_suffixes_of_several_labels_and_odd_hosts(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "1.2.3.4", "[::1]", "com", "me.github.io", "u:p@a.b.com.", "a.b.com:8080"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("site", urls.site_of(F.col("host")))
    rows = df.select("host", urls.domain_of(F.col("site"), ["github.io"]).alias("d"), urls.suffix_of(F.col("site"), ["github.io"]).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"),
        "[::1]": ("[::1]", "[::1]"), "com": ("com", "com"), "me.github.io": ("me.github.io", "github.io"), "u:p@a.b.com.": ("b.com", "com"), "a.b.com:8080": ("b.com", "com"),
    }


def test_url_sql_with_suffixes_of_two_labels(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    sites = [f"{a}.{b}.{c}" for a in ("www", "m") for b in ("one", "two", "six") for c in ("co.uk", "com", "com.au")] + ["9.8.7.6", "[::1]:80", ""]
    urls_ = [(i, f"http://{rng.choice(sites)}/p{i}") for i in range(400)] + [(400, None), (401, "no scheme")]
    labels = [(i, int(rng.random() < (0.9 if "one" in u else 0.2)), int(rng.random() < 0.05)) for i, u in urls_[:300]]
    spark.createDataFrame(urls_, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = db.execute(urls.ORACLE_SQL)
    names = [d[0] for d in want.description]
    want = {r[0]: dict(zip(names, r)) for r in want.fetchall()}
    got = {r.page_id: r.asDict() for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == want and {r["verdict"] for r in got.values()} == {"allow", "block"}


def test_quality_votes_equal_brute_force(spark, smoke):
    """Projection, cosines and votes of the table's documents by plain loops over the labelled vectors."""
    docs, labels = load(spark, smoke, "documents"), load(spark, smoke, "labels")
    model = quality.train(docs, labels.filter(language.fold("doc_id", 5) != 0), "doc_id", "text", "doc_id", "quality", quality.MOST_LABELLED)
    marked = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    texts, hashes = {r.doc_id: (r.text or "").encode() for r in docs.collect()}, common.WordHashes()

    def vector(raw):
        at, n = quality.features(raw, hashes)
        v = np.zeros(quality.LATENT)
        for low, high in quality.KINDS:
            w = {int(a): math.log1p(c) * float(model.idf[a]) for a, c in zip(at, n) if low <= a < high}
            size = math.sqrt(sum(x * x for x in w.values()))
            for a, x in w.items():
                v += x / size * model.to_latent[a]
        return v / max(1e-9, math.sqrt(float(v @ v)))

    known = {i: vector(texts[i]) for i in marked if i in texts}
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op3_quality(spark, smoke).collect()}
    assert set(got) == set(texts)
    for i, raw in texts.items():
        v = vector(raw)
        near = sorted(((float(v @ u), marked[j]) for j, u in known.items()), reverse=True)[: quality.NEIGHBOURS]
        w = [max(c, 0.0) ** quality.POWER + 1e-12 for c, _ in near]
        assert got[i][0] == pytest.approx(sum(a * y for a, (_, y) in zip(w, near)) / sum(w), abs=2e-3)
        assert got[i][1] == (got[i][0] >= 0.3)


def test_latent_space_is_that_of_the_leading_singular_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        at = np.unique(rng.integers(0, 40, 12) + 40 * (i % 5))
        rows.append((at, rng.integers(1, 5, len(at)).astype(np.float32)))
    model = quality.Model(rows, np.arange(300) % 2)
    dense = np.zeros((300, quality.PLACES))
    for d, (at, n) in zip(dense, rows, strict=True):
        at, w = model.weigh(at, n.copy())
        d[at] = w
    want = np.linalg.svd(dense[:, :200], full_matrices=False)[1][: quality.LATENT]
    assert np.linalg.norm(dense @ model.to_latent) == pytest.approx(np.linalg.norm(want), rel=0.02)


def test_quality_learns_from_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(30)] + [(2, "other words"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, "doc_id", "text", "doc_id", "quality", 10)
    assert sorted(model.labels.tolist()) == [0.0, 1.0]


def test_language_mixture_equals_plain_em(spark, smoke):
    """The shares of every language and the choice by penalised likelihood, by plain loops over a document's n-grams."""
    docs = load(spark, smoke, "documents")
    model = language.train(docs)
    for r in docs.filter("n_chars BETWEEN 60 AND 700").orderBy("doc_id").limit(25).collect():
        n = Counter(language.grams(r.text).tolist())
        size = sum(n.values())

        def em(chosen, share):
            for _ in range(language.ROUNDS):
                new = [0.0] * len(chosen)
                for g, c in n.items():
                    parts = [s * model.p[g, k] for s, k in zip(share, chosen)]
                    for j, x in enumerate(parts):
                        new[j] += c * x / sum(parts) / size
                done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
                share = new
                if done:
                    break
            return share, sum(c * math.log(sum(s * model.p[g, k] for s, k in zip(share, chosen))) for g, c in n.items())

        every = list(range(len(model.names)))
        share, value = em(every, [1 / len(every)] * len(every))
        kept = [k for k in every if share[k] >= min(language.LEAST_SHARE, max(share))]
        if len(kept) < len(every):
            total = sum(share[k] for k in kept)
            share, value = em(kept, [share[k] / total for k in kept])
        price = language.PENALTY * math.log(size + 1)
        while len(kept) > 1:
            trials = []
            for j in range(len(kept)):
                rest = [s for i, s in enumerate(share) if i != j]
                less = [k for i, k in enumerate(kept) if i != j]
                trials.append((*em(less, [s / sum(rest) for s in rest]), less))
            best = max(trials, key=lambda x: x[1])
            if value - best[1] > price:
                break
            share, value, kept = best
        want = sorted(zip((model.names[k] for k in kept), share), key=lambda x: -x[1])
        name, top, mix = model.judge(r.text)
        assert name == want[0][0] and top == pytest.approx(want[0][1], abs=1e-6) and dict(mix) == {k: pytest.approx(s, abs=1e-6) for k, s in want}


def test_more_languages_than_a_model_holds_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.identify(docs)


def test_several_files_and_archives_of_a_task(spark, smoke):
    docs, path = load(spark, smoke, "documents").coalesce(1), public_tokenizers.path("byte_bpe_50k.json")
    want = sorted(token_ids.encode_and_read(docs, path).collect())
    assert sorted(token_ids.encode_and_read(docs, path, tokens_per_file=5000).collect()) == want
    pages = load(spark, smoke, "pages").coalesce(1)
    made = warc.write_archives(pages, common.new_folder(spark, "warc"), archive_bytes=20_000)
    made = common.written(made, "archives")
    assert made.count() >= 8 and made.agg(F.sum("records")).first()[0] == pages.count()
    assert sorted(r.page for r in warc.read_archives(made.select("path")).collect()) == sorted(r.page_id for r in pages.collect())


def test_contamination_of_the_table_by_plain_distances(spark, smoke):
    """Every item against every whole text by edit distance: the same items and the same least edits."""
    items = [(r.item_id, decontam.normal(r.text)) for r in load(spark, smoke, "benchmark").collect()]
    docs = [r for r in load(spark, smoke, "documents").collect() if len(r.text or "") < 1200]
    found = {(r.doc_id, r.item_id): r.edits for r in decontam.find_items(load(spark, smoke, "documents"), load(spark, smoke, "benchmark")).collect()}
    assert found
    for d in docs:
        text = decontam.normal(d.text or "")
        for i, t in items:
            edits = decontam.budget(len(t))
            got = 0 if t in text else decontam.myers(t, text, edits) if edits else -1
            assert found.get((d.doc_id, i), -1) == got


@pytest.mark.parametrize("block", [384, 16])
def test_near_copies_of_a_third_of_all_rows(spark, monkeypatch, block):
    """One text repeated exactly, and one in near copies, each a large part of all rows; in one block a bucket and in many."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, rows = [word() for _ in range(80)], []
    for i in range(600):
        if i % 3 == 0:
            text = " ".join(base)
        elif i % 3 == 1:
            copy = [*base, "x", word()]
            copy[rng.randrange(80)] = word()
            text = " ".join(copy)
        else:
            text = " ".join(word() for _ in range(30))
        rows.append((i, text))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_components(rows)


def test_quality_fits_on_what_its_bound_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fit = lambda: len(quality.train(docs, labels, "doc_id", "text", "doc_id", "quality", 100).labels)
    assert fit() == 40
    monkeypatch.setattr(quality, "MOST_TERMS", 1000)
    assert 5 < fit() < 20
    monkeypatch.setattr(quality, "MOST_TERMS", 1)
    assert fit() == 1


def test_filters_hand_columns_of_any_type_on(spark, twice):
    extra = {
        "void": F.lit(None), "map": F.create_map(F.lit("a"), F.col("__sha")), "struct": F.struct("lang", F.array("doc_id").alias("x")), "time": F.lit("2030-01-02 03:04:05.678").cast("timestamp"),
        "local": F.lit("2030-01-02 03:04:05").cast("timestamp_ntz"), "day": F.lit("2030-01-02").cast("date"), "dec": F.lit("1.25").cast("decimal(20,5)"), "raw": F.lit("x").cast("binary"), "span": F.expr("INTERVAL 3 DAYS"),
        "month": F.expr("INTERVAL 2 MONTHS"), "tiny": F.lit(3).cast("tinyint"), "real": F.lit(1.5).cast("float"),
    }
    docs = twice.withColumns(extra)
    items = spark.createDataFrame([(1, "a benchmark question about the capital city")], "item_id long, text string")
    for kept in (language.keep_identified(docs), decontam.keep_clean(docs, items), exact.keep_first_copies(docs), near.keep_one_each(docs)):
        assert kept.schema.simpleString() == docs.schema.simpleString()
        shown = lambda df: df.withColumn("month", F.col("month").cast("string")).collect()
        rows = shown(kept)
        want = {r["__id"]: r for r in shown(docs)}
        assert rows and all(r == want[r["__id"]] for r in rows)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(away)
    away.conf = SimpleNamespace(get=lambda *a: "hdfs://shared/folder/")
    assert tables.shared_dir(away) == "hdfs://shared/folder"
