"""Behaviour of the retrieval engine, ingestion and chunking on small rows."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import corpus, engine, evaluate, ingest, trends
from quern.operators import retrieval as R
from quern.operators.access import AccessContext
from quern.operators.chunking import Chunker, chunk_documents, split_long, split_markdown
from quern.plans import relation


def hits(spark, rows):
    return spark.createDataFrame([(1, i, r) for r, i in enumerate(rows, 1)], "query_id int, id string, rank int")


def test_rrf_shared_id_first_and_ties_by_id(spark):
    got = R.rrf([hits(spark, "sv"), hits(spark, "sk")], 10, by=["query_id"]).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [("s", 1), ("k", 2), ("v", 3)]
    assert got[0].score == pytest.approx(2 / 61, abs=1e-9) and got[1].score == pytest.approx(1 / 62, abs=1e-9)
    flipped = R.rrf([hits(spark, "sk"), hits(spark, "sv")], 10, by=["query_id"])
    assert {(r.id, r.score) for r in flipped.collect()} == {(r.id, r.score) for r in got}
    assert R.rrf([hits(spark, "sv")], 0, by=["query_id"]).count() == 0 and R.rrf([hits(spark, "sv")], 5, k=0).count() == 0


def test_budget_cuts_the_last_hit_and_skips_blank_ones(spark):
    rows = spark.createDataFrame([(1, "a", 1, "aaaaa"), (1, "b", 2, "  \n"), (1, "c", 3, "bbbbb"), (1, "d", 4, "ccccc")], "query_id int, id string, rank int, content string")
    got = R.within_budget(rows, ["query_id"], 5, 8).orderBy("rank").collect()
    assert [(r.rank, r.content) for r in got] == [(1, "aaaaa"), (2, "bbb")]
    assert [r.id for r in R.within_budget(rows, ["query_id"], 2, 100).orderBy("rank").collect()] == ["a", "c"]


def test_rerank_prefers_coverage_and_keeps_the_tail(spark):
    rows = spark.createDataFrame([(1, "x", 1, "nothing here", ""), (1, "y", 2, "timeout of the upload worker", "worker"), (1, "z", 3, "upload worker timeout", "")], "query_id int, id string, rank int, content string, title string")
    got = R.heuristic_rerank(rows, F.lit("upload worker timeout"), ["query_id"], most=2).orderBy("rank").collect()
    assert [r.id for r in got] == ["y", "x", "z"] and got[2].score == 0


def test_outside_order_drops_unknown_ids_and_appends_the_rest(spark):
    order = spark.createDataFrame([(1, "c", 1), (1, "?", 2), (1, "a", 3), (1, "c", 4)], "query_id int, id string, position int")
    got = R.merge_order(hits(spark, "abc"), order, ["query_id"]).orderBy("rank").collect()
    assert [r.id for r in got] == ["c", "a", "b"]


def test_bm25_fixture(spark):
    from quern.plans import q_more

    got = {(r.query_id, r.rank): r.id for r in q_more.r26(spark, "").collect()}
    assert got[1, 1] == "exact-a" and got[2, 1] == "north"


def test_websearch_grammar(spark):
    rows = spark.createDataFrame([(1, "red green blue"), (2, "green red"), (3, "blue sky"), (4, None)], "id int, t string")
    find = lambda q: {r.id for r in rows.filter(R.fts_match(R.fts_words(F.col("t")), q)).collect()}
    assert find("red green") == {1, 2} and find('"red green"') == {1} and find("red -blue") == {2} and find("sky or green") == {1, 2, 3} and find("") == set()


def test_vector_search_pushes_the_top_k_down(spark, smoke):
    e = relation.table(spark, smoke, "embeddings")
    plan = R.vector_topk(e, [0.1] * 64)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        R.vector_topk(e, [])
    one = {(r.vec_id, r.rank, r.score) for r in R.vector_topk(e, list(e.filter("vec_id = 7").first().embedding)).collect()}
    both = R.vector_topk_batch(e, e.filter("vec_id IN (7, 8)"), query_block=1)
    assert {(r.id, r.rank, r.score) for r in both.filter("query_id = 7").collect()} == one


def test_access(spark, smoke):
    assert AccessContext.of("ADMIN", "") == AccessContext("admin", None, None)
    assert AccessContext.of("x", "t") == AccessContext("public", "t", None)
    assert AccessContext.of("hr", None) == AccessContext("hr", "default", "hr")
    seen = relation.documents(spark, smoke).filter(AccessContext.of("hr", None).predicate())
    assert {(r.access_level, r.department) for r in seen.collect()} <= {("public", "engineering"), ("internal", "hr")}


def test_fallbacks(spark):
    ok, bad = (lambda: hits(spark, "ab")), (lambda: (_ for _ in ()).throw(RuntimeError("away")))
    router = engine.LexicalRouter({"FTS": ok})
    assert engine.retrieve("HYBRID", ok, router, lambda h: h).fallback is None
    assert engine.retrieve("HYBRID", bad, router, lambda h: h).fallback == "FTS_ONLY"
    assert engine.retrieve("HYBRID", ok, engine.LexicalRouter({"FTS": bad}), lambda h: h).fallback == "VECTOR_ONLY"
    assert engine.retrieve("HYBRID", bad, engine.LexicalRouter({"FTS": bad}), lambda h: h).hits is None
    assert engine.retrieve("HYBRID_RERANK", ok, router, lambda h: 1 / 0).fallback == "RRF"
    with pytest.raises(RuntimeError):
        engine.LexicalRouter({"FTS": ok, "BM25": bad}, "BM25", fail_open=False).hits()
    assert engine.needs_second_pass(2, "q") and engine.needs_second_pass(9, "q" * 180) and not engine.needs_second_pass(9, "q")
    assert engine.parse_strategy(" hybrid ") == "HYBRID" and engine.parse_strategy(None) == "HYBRID_RERANK"


def test_change_detection(spark):
    key = [("c", "s", x) for x in "abcde"]
    old = spark.createDataFrame([(*key[0], "d1", "h", "f", 4, False), (*key[1], "d2", "h", "f", 4, False), (*key[2], "d3", "h", "f0", 2, False), (*key[3], "d4", "h", "f", 3, True)], "corpus_id string, source string, external_id string, document_id string, content_hash string, index_fingerprint string, version int, deleted boolean")
    new = spark.createDataFrame([(*key[0], "n", "h", "f"), (*key[1], "n", "h2", "f"), (*key[2], "n", "h", "f"), (*key[3], "n", "h", "f"), (*key[4], "n", "h", "f")], "corpus_id string, source string, external_id string, document_id string, content_hash string, index_fingerprint string")
    got = {r.external_id: (r.status, r.version, r.document_id) for r in ingest.detect_changes(new, old).collect()}
    assert got == {"a": (ingest.SAME, 4, "d1"), "b": (ingest.CHANGED, 5, "d2"), "c": (ingest.PIPELINE, 3, "d3"), "d": (ingest.PIPELINE, 4, "d4"), "e": (ingest.NEW, 1, "n")}
    changed = ingest.detect_changes(new, old).filter(F.col("status") != ingest.SAME)
    merged = ingest.upserted(old, changed)
    assert {r.external_id: (r.version, r.deleted) for r in merged.collect()} == {"a": (4, False), "b": (5, False), "c": (3, False), "d": (4, False), "e": (1, False)}
    assert ingest.detect_changes(new, merged).filter(F.col("status") != ingest.SAME).count() == 0


def test_batches_are_refused_whole(spark):
    rows = spark.createDataFrame([("a", "s", "t", "x", "c", None, None, None)] * 3, "external_id string, source string, source_type string, title string, content string, tenant_id string, department string, access_level string")
    assert ingest.batch(rows).count() == 3
    for wrong in (rows.limit(0), rows.unionByName(rows.limit(1).withColumn("source", F.lit(" ")))):
        with pytest.raises(ValueError):
            ingest.batch(wrong)
    with pytest.raises(ValueError):
        ingest.batch(rows, 2)


def test_markdown_folder(spark, tmp_path):
    from quern.sources.archives import markdown_files

    with pytest.raises(ValueError):
        (tmp_path / "e").mkdir()
        (tmp_path / "e" / "x.txt").write_text("x")
        markdown_files(spark, str(tmp_path / "e"))
    (tmp_path / "e" / "b.md").write_text("# b")
    assert [(r.source, r.text) for r in markdown_files(spark, str(tmp_path / "e")).collect()] == [("b.md", "# b")]


def test_activation_keeps_one_active(spark):
    c = relation.corpora(spark)
    for moved in (corpus.activate(c, "corpus-b", 9), corpus.rollback(c, "corpus-c", 9)):
        assert moved.filter("state = 'ACTIVE'").count() == 1 and moved.count() == c.count()
    for wrong in ("corpus-c", "corpus-d", "nothing"):
        with pytest.raises(ValueError):
            corpus.activate(c, wrong, 9)
    with pytest.raises(ValueError):
        corpus.set_state(c, "corpus-b", "BROKEN")


def test_chunker_sections():
    c = Chunker(32, 0)
    got = list(c.chunks("# Widget API\n\nLimit is 8 units.\n\n## Quotas\n\nQuota is 40 units.", "Title"))
    assert [p for p, _ in got] == ["Title > Widget API", "Title > Widget API > Quotas"]
    text = " ".join(f"w{i}" for i in range(90))
    parts = [t for _, t in c.chunks(text, "")]
    assert len(parts) > 1 and all(len(t.split()) <= 32 for t in parts) and " ".join(parts).split() == text.split()
    a, b = " ".join(f"a{i}" for i in range(24)), " ".join(f"b{i}" for i in range(24))
    one, two = [t for _, t in Chunker(32, 5).chunks(f"{a}\n\n{b}", "")]
    assert one == a and two.endswith(b) and a.endswith(two.split("\n\n")[0]) and len(two.split()) <= 32
    assert len(list(c.blocks("```\n\n# not a heading\n~~~\n\n```\n\nend", "t"))) == 2
    assert list(c.chunks("", "t")) == []
    for wrong in ((31, 0), (40, 40), (40, -1)):
        with pytest.raises(ValueError):
            Chunker(*wrong)


def test_chunks_of_the_table_hold_every_word(spark, smoke):
    docs = relation.documents(spark, smoke)
    got = chunk_documents(docs, Chunker(64, 0)).orderBy("id", "chunk_index").collect()
    assert all(r.token_count <= 64 for r in got)
    words = {}
    for r in got:
        words.setdefault(r.id, []).extend(r.content.split())
    for r in docs.collect():
        assert words.get(str(r.id), []) == (r.content or "").split()


def test_markdown_sections():
    text = "---\ndocument_type: note\n---\n# Name\n## One\n\nbody\n### Part\nmore\n## Empty\n---\n"
    got = list(split_markdown(text))
    assert [(t, s, p) for t, s, p, _, _ in got] == [("Name", "One", ""), ("Name", "One", "Part")] and got[0][4] == {"document_type": "note"}
    assert split_long("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5] and split_long("ab\n\ncd", 10) == ["ab\n\ncd"]


def test_text_helpers(spark):
    row = spark.createDataFrame([("﻿a \r\nb\t\r", "企业知识库 介绍 C++")], "t string, h string").select(T.normalise(F.col("t")).alias("n"), T.tokens(F.col("h")).alias("k"), T.rerank_tokens(F.col("h")).alias("r")).first()
    assert row.n == "a\nb" and row.k == ["c++", "企业", "业知", "知识", "识库"] and "知识" in row.r and "企业知识库" in row.r


def test_metrics_fixture(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "a", "b"]), (2, [], ["a"])], "question_id int, expected array<string>, retrieved array<string>")
    got = {r.k: r for r in evaluate.per_question(rows, [1, 3]).collect()}
    assert got[1].hit == 0 and got[3].recall == 1 and got[3].precision == pytest.approx(2 / 3) and got[1].rr == got[3].rr == 0.5 and got[1].truncated_rr == 0
    from math import log2

    assert got[3].ndcg == pytest.approx((1 / log2(3) + 1 / log2(4)) / (1 + 1 / log2(3)))


def test_trend_page_and_splice():
    html = '<article class="Box-row"><h2><a href="/o/agent">o / agent</a></h2><p class="col-9">An | agent</p><a href="/o/agent/stargazers">1,234</a><span class="float-sm-right">56 stars this week</span></article><article class="Box-row"><h2>none</h2></article>'
    assert trends.parse_articles(html) == [("o/agent", "An | agent", 56, 1234)]
    doc = f"snapshot_date: x\nexpires_at: y\n{trends.START}\nold\n{trends.END}\ntail"
    got = trends.spliced(doc, ["| r |"], "2030-01-01", "2030-01-15")
    assert "old" not in got and "| r |" in got and got.endswith("tail") and "expires_at: 2030-01-15" in got
    with pytest.raises(ValueError):
        trends.spliced("no markers", [], "", "")


def test_sources(spark, tmp_path):
    import zipfile

    from quern.sources import archives

    (tmp_path / "t" / "Wiki-Pages").mkdir(parents=True)
    (tmp_path / "t" / "Wiki-Pages" / "dsid_7_x.txt").write_bytes("﻿Title\r\nbody".encode())
    (tmp_path / "t" / "Wiki-Pages" / "empty.txt").write_text(" \n")
    got = archives.derived(archives.text_files(spark, str(tmp_path / "t"))).collect()
    assert [(r.source_type, r.external_id, r.title, r.content) for r in got] == [("wiki_pages", "dsid_7", "Title", "Title\nbody")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b/two.txt", "2")
        z.writestr("a/one.txt", "1")
        z.writestr("a/skip.md", "x")
    assert [r.path for r in archives.zip_members(spark, str(tmp_path / "a.zip")).collect()] == ["a/one.txt", "b/two.txt"]
    with pytest.raises(ValueError):
        archives.check_archive("x.zip.partial")


def test_stream_is_taken_in_once(spark, tmp_path):
    from quern.streaming.ingest import SCHEMA, VersionedTable, ingest_stream

    src, schema = str(tmp_path / "in"), "source string, external_id string, content string"
    spark.createDataFrame([("s", "a", "1"), ("s", "b", "2")], schema).write.parquet(src)
    table = VersionedTable(spark, str(tmp_path / "table"))
    run = lambda: ingest_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "cp"), "f")
    run()
    run()
    assert {(r.external_id, r.version) for r in table.read(SCHEMA).collect()} == {("a", 1), ("b", 1)}
    spark.createDataFrame([("s", "b", "3"), ("s", "c", "4")], schema).write.mode("append").parquet(src)
    run()
    assert {(r.external_id, r.version) for r in table.read(SCHEMA).collect()} == {("a", 1), ("b", 2), ("c", 1)}
