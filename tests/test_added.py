"""Index, ranks, snapshots, chunking by tokens, sources and adapters on small rows."""

import json
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking as C
from quern.operators import evaluate, trends
from quern.operators import retrieval as R
from quern.operators.corpus import freshness_note
from quern.operators.index import BestOf, LexicalIndex
from quern.sources import archives
from quern.sources.tables import numbered


def test_best_of_keeps_the_same_as_a_sort():
    rng = np.random.default_rng(1)
    best, rows = BestOf(5, 7), []
    for k in range(6):
        ids = rng.permutation(1000)[:40] + 1000 * k
        scores = np.round(rng.random((5, 40)), 1)
        best.add(ids, scores, scores >= 0.2)
        rows += [(q, -scores[q, i], ids[i]) for q in range(5) for i in range(40) if scores[q, i] >= 0.2]
    want = [r for q in range(5) for r in sorted(x for x in rows if x[0] == q)[:7]]
    assert list(zip(best.query, -best.score, best.id, strict=True)) == want


def test_index_topk_equals_all_scores(spark, monkeypatch):
    from quern.operators import index

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(400)] + [(400, None)], "id long, t string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=5))) for q in range(23)] + [(90, "unknown"), (91, None)], "q int, t string")
    found = LexicalIndex(docs, "id", F.col("t"))
    every = R.ranked(R.bm25_scores(found, asked, "t", "q"), ["query_id"], "score", "id", 6)
    want = {(r.query_id, r.id, r.score, r["rank"]) for r in every.collect()}
    for block in (1024, 4):
        monkeypatch.setattr(index, "MOST_QUERIES", block)
        assert {(r.query_id, r.id, r.score, r["rank"]) for r in R.bm25_topk(found, asked, "t", "q", 6).collect()} == want
    assert R.bm25_topk(found, asked.limit(0), "t", "q").count() == 0


def test_vector_batch_without_queries_and_with_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert R.vector_topk_batch(e, e.limit(0)).count() == 0
    got = {(r.query_id, r.id, r["rank"]) for r in R.vector_topk_batch(e, e.filter("vec_id IN (1, 3)"), k=2).collect()}
    assert got == {(1, 1, 1), (1, 5, 2)}


def test_numbered_equals_a_sort(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 50)) for i in range(3000)]
    got = {r.id: r.place for r in numbered(spark.createDataFrame(rows, "id int, v int").repartition(6), "place", F.desc("v"), "id").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert numbered(spark.createDataFrame([], "id int"), "place", "id").count() == 0


ROW = '<article class="Box-row"><h2><a href="/login">in</a> <a href="/{r}">x</a></h2><p class="col-9 color">{d}</p><a href="/{r}/stargazers"> {t} </a><span class="d-inline-block float-sm-right">{p} stars this {w}</span></article>'


def test_page_rows_by_structure():
    html = "<main>" + ROW.format(r="o/one.js", d="first <b>agent</b>\n tool &amp; more", t="12,345", p="1,002", w="week") + ROW.format(r="o/two", d="", t="many", p="no", w="month") + ROW.format(r="o/a/b", d="x", t="1", p="1", w="week") + "<article class='Box-row'><h2><a href='/p/q'>y</a></h2></article></main><p class='col-9'>outside</p>"
    assert trends.parse_articles(html) == [("o/one.js", "first agent tool & more", 1002, 12345), ("o/two", "", 0, 0), ("p/q", "", 0, 0)]
    assert trends.parse_articles(None) == [] and trends.parse_articles("<article class='Box-row'><h2><a href='/p/q'>unclosed") == [("p/q", "", 0, 0)]
    assert trends.parse_headings("<h1>A <i>b</i></h1><div><h3>C</h3></div><br></p><h2>D") == [("h1", "A b"), ("h3", "C"), ("h2", "D")]
    assert trends.repo_of("/a/b") == "a/b" and trends.repo_of("/a/b c") is None and trends.repo_of("a/b") is None and trends.repo_of("//b") is None


def test_splice_replaces_places_only():
    text = f"---\nsnapshot_date: 2026-01-01\nexpires_at: 2026-01-15\n---\n# T\n{trends.START}\nold\n{trends.END}\n## notes\nkeep {{}} \\1\n"
    new = trends.spliced(text, ["| r |"], "2026-08-25", "2026-09-08")
    assert "snapshot_date: 2026-08-25\nexpires_at: 2026-09-08\n" in new and "| r |" in new and "old" not in new and new.endswith("## notes\nkeep {} \\1\n")
    assert trends.spliced(new, ["| r |"], "2026-08-25", "2026-09-08") == new
    for wrong in ("no markers", text + trends.START, trends.END + "\n" + trends.START):
        with pytest.raises(ValueError):
            trends.spliced(wrong, [], "a", "b")


def test_han_text_is_split_and_overlaps():
    c = C.Chunker(32, 8)
    text = "".join(chr(0x4E00 + i % 5000) for i in range(2000))
    parts = [x for _, x in c.chunks(text, "t")]
    assert all(C.words(p) <= 32 for p in parts) and len(parts) >= 2000 // 32
    assert c.tail(text, 10) == text[-10:] and c.tail("", 5) == "" and c.tail("one two three four", 2) == "three four"
    assert C.words("中文 ab cd") == 4
    sentences = " ".join(f"Sentence number {i} has a few words." for i in range(60))
    chunks = [x for _, x in c.chunks(sentences, "t")]
    assert all(c.count(x) <= 32 for x in chunks) and any(chunks[i + 1].split("\n\n")[0] in chunks[i] for i in range(len(chunks) - 1))


def test_a_vocabulary_counts_tokens():
    tokenizers = pytest.importorskip("public_tokenizers")
    count = C.Vocabulary(tokenizers.path("byte_bpe_50k.json"))
    c = C.Chunker(64, 10, count)
    text = "".join(chr(0x4E00 + i) for i in range(400)) + " and some words. " * 80
    parts = [x for _, x in c.chunks(text, "title")]
    assert all(count(p) <= 64 for p in parts) and len(parts) > 10


def test_cutting_is_in_proportion_to_the_text():
    calls = []

    def count(text):
        calls.append(len(text))
        return len(text)

    c = C.Chunker(100, 0, count)
    assert "".join(c.cut("x" * 50_000)) == "x" * 50_000
    assert sum(calls) < 60 * 50_000


def test_bad_members_and_page_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/good.txt", "good words")
        z.writestr("x/bad.txt", "bad words that are long enough")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"bad words")] ^= 0xFF
    (tmp_path / "b.zip").write_bytes(raw)
    (tmp_path / "c.zip").write_bytes(b"not an archive")
    got = {(r.archive.rpartition("/")[2], r.member) for r in archives.bad_members(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {("b.zip", "x/bad.txt"), ("c.zip", None)}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.html").write_text("<style>x</style><p>Hello&nbsp;&lt;you&gt;</p><script>if (a < b) {}</script><!-- no -->")
    (tmp_path / "p" / "two.txt").write_text("para one\n\npara two")
    (tmp_path / "p" / "three.bin").write_bytes(b"\x00")
    pages = {r.path.rpartition("/")[2]: r.content for r in archives.pages_as_documents(spark, str(tmp_path / "p")).collect()}
    assert pages == {"one.html": "Hello <you>", "two.txt": "para one\n\npara two"}


def test_json_batch_and_predictions(spark, tmp_path):
    doc = {"external_id": "e", "source": "s", "source_type": "t", "title": "x", "content": "c"}
    (tmp_path / "b.json").write_text(json.dumps({"documents": [doc, doc | {"external_id": "f"}]}, indent=1))
    assert archives.json_batch(spark, str(tmp_path / "b.json")).count() == 2
    with pytest.raises(ValueError):
        archives.json_batch(spark, str(tmp_path / "b.json"), 1)
    rows = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "question_id int, answer string, score double")
    back = archives.write_predictions(rows, f"file://{tmp_path}/out")
    assert sorted(back.collect()) == sorted(rows.collect()) and back.schema == rows.schema
    with pytest.raises(ValueError):
        archives.write_predictions(rows.unionByName(spark.createDataFrame([(None, "x", None)], rows.schema)), f"file://{tmp_path}/no")


def test_prefixes_fail_or_stay_open(spark):
    assert C.contextual_prefix(lambda d, c: " a\x00b ", "d", "c") == "ab" and len(C.contextual_prefix(lambda d, c: "x" * 999, "d", "c", 120)) == 120
    for bad in (lambda d, c: " ", lambda d, c: 1 / 0):
        with pytest.raises((ValueError, ZeroDivisionError)):
            C.contextual_prefix(bad, "d", "c")
        assert C.contextual_prefix(bad, "d", "c", fail_open=True) == ""
    with pytest.raises(ValueError):
        C.with_prefixes(spark.createDataFrame([("d", "c")], "document string, content string"), lambda d, c: d, most=50)


def test_notes_and_outside_scores(spark):
    rows = [(1, None, None), (2, "2030-01-01", "2030-02-01"), (3, "2030-01-01", "2031-01-01"), (4, "2030-01-01", "garbage"), (5, " ", " ")]
    got = {r.n: r.t for r in spark.createDataFrame(rows, "n int, s string, e string").select("n", freshness_note(F.col("s"), F.col("e"), "2030-06-15").alias("t")).collect()}
    assert got[1] == got[5] == "" and "已于 2030-02-01 过期" in got[2] and got[3] == "快照日期 2030-01-01，有效期至 2031-01-01。" and "garbage" in got[4]
    row = evaluate.outside_scores(spark.createDataFrame([("q", "g", "a", ["c"])], "question string, ground_truth string, answer string, contexts array<string>")).first()
    assert (row.status, row.scores) == ("NOT_EXECUTED", {}) and row.reason


def test_page_parsing_is_linear():
    def seconds(n):
        html = "<div>" + ROW.format(r="o/x", d="words", t="1", p="2", w="week") * n + "</div>"
        t = time.perf_counter()
        assert len(trends.parse_articles(html)) == n
        return time.perf_counter() - t

    seconds(50)
    assert seconds(2000) < 30 * seconds(200) + 0.5


def test_full_context_stops_at_its_limit(spark):
    docs = spark.createDataFrame([(1, "four"), (2, "sixsix"), (3, None)], "id int, content string")
    assert R.full_context(docs, 10).count() == 3 and R.full_context(docs, 9).count() == 0


def test_knowledge_files_without_chunks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# only a title\n")
    with pytest.raises(ValueError, match="no chunks"):
        archives.knowledge_corpus(spark, str(tmp_path))
    (tmp_path / "b.md").write_text("# T\n## S\nwords\n")
    assert archives.knowledge_corpus(spark, str(tmp_path)).count() == 1


def test_members_leave_in_several_frames(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        for i in range(30):
            z.writestr(f"d/{i:02d}.txt", f"text {i}")
        z.writestr("d/skip.md", "x")
    got = archives.zip_members(spark, str(tmp_path / "m.zip")).collect()
    assert [(r.path, bytes(r.content)) for r in got] == [(f"d/{i:02d}.txt", f"text {i}".encode()) for i in range(30)]


def test_tables_of_a_database(spark):
    from quern.sources.jdbc import Database, replica

    db = Database("jdbc:derby:memory:quern-test;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver", most_connections=3)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(None, "no key")], "id long, t string")
    db.write(rows, "docs")
    for found in (db.table(spark, "docs"), db.table(spark, "docs", "id")):
        assert sorted((r[0] if r[0] is not None else -1, r[1]) for r in found.collect()) == sorted((r.id if r.id is not None else -1, r.t) for r in rows.collect())
    ranged = db.table(spark, "docs", "id")
    assert ranged.rdd.getNumPartitions() == 3 and "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,7)" in ranged.filter("id = 7")._jdf.queryExecution().executedPlan().toString().replace("id", "ID")
    away = replica(Database("jdbc:derby:memory:nowhere", driver="org.apache.derby.jdbc.EmbeddedDriver"))
    assert away.timeout_s == 3 and away.most_connections == 4 and "password" not in repr(away)
    with pytest.raises(Exception, match="nowhere"):
        away.table(spark, "docs")
    for wrong in ({"url": "http://x"}, {"url": "jdbc:x", "most_connections": 0}):
        with pytest.raises(ValueError):
            Database(**wrong)


def test_admin_gate_and_frame_order(spark):
    from quern.operators.access import admin_allowed
    from quern.operators.engine import answer_frames

    rows = spark.createDataFrame([(1, "t"), (2, "T"), (3, None), (4, "")], "n int, g string")
    ask = lambda token: {r.n: r.ok for r in rows.select("n", admin_allowed(token, F.col("g")).alias("ok")).collect()}
    assert ask("t") == {1: True, 2: False, 3: False, 4: False} and not any(ask("").values()) and not any(ask(None).values())
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, n int, payload string")
    one = lambda x: spark.createDataFrame([(1, x)], "query_id int, payload string")
    got = [(r.place, r.kind, r.payload) for r in answer_frames(one("s"), parts, one("m")).orderBy("place").collect()]
    assert got == [(1, "sources", "s"), (2, "text", "a"), (3, "text", "b"), (4, "metrics", "m")]


def test_a_sealed_database_is_read_by_other_processes(spark, tmp_path):
    import subprocess
    import sys

    from quern.sources.jdbc import Database, replica, sealed

    texts = ["", " a ", 'say "x", y', "two\nlines\r\nand\rmore", "é中\t", "'", '"', "x" * 70_000, "\\", ",", "#"]
    rows = spark.createDataFrame([(i, t, i / 3, i % 2 == 0) for i, t in enumerate(texts)] + [(None, None, None, None)], "id long, t string, x double, b boolean").repartition(3)
    want = sorted(rows.collect(), key=str)
    db = sealed(rows, "kept")
    assert sorted(db.table(spark, "kept").collect(), key=str) == want == sorted(db.table(spark, "kept", "id").collect(), key=str)
    assert db.table(spark, "kept", "id").rdd.getNumPartitions() == 8 and replica(db).table(spark, "kept").filter("id >= 3").count() == len(texts) - 3
    assert sealed(rows.limit(0), "empty_one").table(spark, "empty_one", "id").count() == 0
    with pytest.raises(ValueError, match="timestamp"):
        sealed(spark.sql("SELECT current_timestamp() AS at"), "at")
    other = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", s.read.format("jdbc").options(**{db.options()!r}).option("dbtable", "kept").load().count())"""
    assert f"rows {len(texts) + 1}" in subprocess.run([sys.executable, "-c", other], capture_output=True, text=True, cwd=tmp_path, timeout=120).stdout


@pytest.mark.parametrize("name", ["s11_database_table", "s12_search_replica"])
def test_database_queries_where_tasks_run_in_other_processes(spark, smoke, name, monkeypatch):
    from quern.plans import q_added, registry

    made = []
    monkeypatch.setattr(q_added, "sealed", lambda *a, f=q_added.sealed: made.append(f(*a)) or made[-1])
    want = sorted(registry.queries()[name](spark, smoke).collect())
    assert not made
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    assert sorted(registry.queries()[name](spark, smoke).collect()) == want and len(made) == 1


def test_the_search_replica_has_its_columns_whatever_else_the_table_has(spark, smoke, tmp_path, monkeypatch):
    import duckdb

    from quern.plans import registry

    more = spark.read.parquet(f"{smoke}/benchmark.parquet").select(F.current_timestamp().alias("at"), "text", F.array("text").alias("tags"), "item_id")
    more.union(spark.sql("SELECT now(), NULL, NULL, 7L UNION ALL SELECT NULL, 'x', NULL, NULL")).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["s12_search_replica"]).fetchall(), key=str)
    for master in ("local[4]", "local-cluster[2,1,1024]"):
        monkeypatch.setattr(spark.sparkContext, "master", master)
        got = registry.queries()["s12_search_replica"](spark, str(tmp_path))
        assert got.columns == ["item_id", "text"] and sorted(map(tuple, got.collect()), key=str) == want


def test_page_headings_equal_their_sql_on_odd_pages(spark, tmp_path):
    import duckdb

    from quern.plans import registry

    pages = [
        "<h1>a &amp; b &amp</h1><h2>&quot;c&quot; &#39; &nbsp; &eacute;</h2>", "<H1 class='x'>Up\n\t per</H1><h2>open", "<h1>one</h2><h3>two</h3>", "<h1>out<h2>in</h2>rest</h1>",
        "<!-- <h1>no</h1> --><script>'<h2>s</h2>'</script>", "<h7>x</h7><header>y</header><h1x>z</h1><h1é>w</h1>", "<h1></h1><h2> \x0b v   　 </h2>", "<h1>&amp;lt; &amp;amp;</h1>",
        "<h1 title='a>b'>t</h1>", "<h1>a < b > c</h1>", "<h1 </h1>", "<h4\n>n\r\nm</h4 ><h5>k</h5>", "", None, "no heading", "</h1><h6>last</h6>",
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names = ["page_id", "rank", "name", "description", "period_stars", "total_stars"]
    got = registry.queries()["s16_page_headings"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got.select(names).collect())) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()['s16_page_headings']})").fetchall())


def test_headings_of_a_page_that_closes_none_take_no_longer(spark):
    page = spark.createDataFrame([(1, "<h2>only</h2>" + "<h1>" * 200_000), (2, "x" * 3_000_000 + "<h1>" + "y" * 3_000_000 + "</h1>")], "page_id long, html string")
    t = time.perf_counter()
    assert [(r.page_id, r.name, len(r.description)) for r in trends.page_rows(page, "headings").orderBy("page_id").collect()] == [(1, "h2", 4), (2, "h1", 3_000_000)]
    assert time.perf_counter() - t < 30


def test_terms_are_counted_without_python(spark):
    from collections import Counter

    from quern.functions.text import tokens
    from quern.operators.index import counted

    rng = random.Random(7)
    texts = [None, "", " . ", "aa", "aa aa", "bb aa bb AA", "中文检索 中文 ab", *(" ".join(rng.choices(["aa", "bb", "c+", "d#d", "检索", "éé"], k=rng.randint(0, 60))) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    want = {r.id: Counter(r.w) for r in docs.select("id", tokens(F.col("t")).alias("w")).collect()}
    found = docs.select("id", counted(tokens(F.col("t"))).alias("x"))
    for r in found.collect():
        assert r.x.dl == want[r.id].total() and len(set(r.x.terms)) == len(r.x.terms) and dict(zip(r.x.terms, r.x.tfs, strict=True)) == want[r.id]
    assert "Python" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "InArrow" not in plan
    index = LexicalIndex(docs, "id", F.col("t"))
    assert {(r.id, r.term): (r.tf, r.dl) for r in index.postings().collect()} == {(i, t): (n, c.total()) for i, c in want.items() for t, n in c.items()}


def test_batches_of_the_search_hold_asked_terms_alone(spark, monkeypatch):
    """Documents of many words that no query has: the bytes that go to Python don't depend on them."""
    from quern.operators import index

    size = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(index, "whole", lambda batches, key, f=index.whole: f((size.add(b.nbytes) or b for b in batches), key))
    docs = spark.createDataFrame([(i, "asked " * (1 + i % 3) + " ".join(f"w{i}x{n}" for n in range(2000))) for i in range(60)], "id long, t string")
    asked = spark.createDataFrame([(1, "asked"), (2, "w7x5 asked")], "q int, t string")
    found = R.bm25_topk(index.LexicalIndex(docs, "id", F.col("t")), asked, "t", "q", 3)
    got = {(r.query_id, r["rank"]): r.id for r in found.collect()}
    assert got[2, 1] == 7 and len(got) == 6 and 0 < size.value < 60 * 2000


def test_neighbours_stay_together_across_batches():
    import pyarrow as pa

    from quern.operators.index import whole

    rng = random.Random(9)
    keys = [k for k in range(50) for _ in range(rng.randint(1, 12))]
    for n in (1, 3, 7, 1000):
        parts = [p.column("k").to_pylist() for p in whole((pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + n], pa.int64())}) for i in range(0, len(keys), n)), "k")]
        assert sum(parts, []) == keys and all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
    assert list(whole(iter([]), "k")) == []
