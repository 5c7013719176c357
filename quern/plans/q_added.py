"""Sources, sinks and adapters: visible text, JSON batches, predictions, prefixes and outside scores."""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking as C
from quern.operators import evaluate as E
from quern.operators import ingest
from quern.operators.access import admin_allowed
from quern.operators.engine import answer_frames
from quern.plans.q_retrieval import LISTS, _lexical
from quern.plans.registry import query
from quern.plans.relation import table
from quern.sources import archives
from quern.sources.jdbc import Database, in_memory, replica, sealed
from quern.sources.tables import new_folder, write_files

_VISIBLE = r"""regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', ' ', 'gis'), '<[a-zA-Z/!?][^>]*>', ' ', 'g')"""
for _name, _c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _VISIBLE = f"replace({_VISIBLE}, '{_name}', {_c})"
_VISIBLE = rf"trim(regexp_replace({_VISIBLE}, '[ \t\r\n\f]+', ' ', 'g'), ' ')"


def _zip(names, texts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in sorted(zip(names, texts, strict=True)):
            z.writestr(zipfile.ZipInfo(name), text or "")
    return out.getvalue()


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of archives of fifty documents each, by number; members are named by language and number."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("b"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), "text")
    packed = F.pandas_udf(lambda n, t: pd.Series([_zip(x, y) for x, y in zip(n, t, strict=True)]), "binary")
    grouped = d.groupBy("b").agg(F.collect_list(F.struct("name", F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
    return grouped.select(F.concat(F.lit("a"), "b", F.lit(".zip")).alias("path"), packed("x.name", "x.text").alias("content"))


@query("s1_text_files", "SELECT lang || '/f' || doc_id // 50 || '.txt' AS path, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS content_md5 FROM documents WHERE text IS NOT NULL GROUP BY lang, doc_id // 50")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.text_files(spark, _text_folder(spark, sf_dir)).select("path", F.md5("content").alias("content_md5"))


@query("s4_checksums", "SELECT 'f' || doc_id // 50 || '.txt' AS file, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY lang, doc_id // 50")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.checksums(spark, f"{_text_folder(spark, sf_dir)}/*/*.txt")
    return found.select(F.substring_index("path", "/", -1).alias("file"), "sha256")


def _text_folder(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files in a folder for each language, fifty numbers a file."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy("lang", F.floor(F.col("doc_id") / 50).alias("b")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    folder = new_folder(spark, "texts")
    content = F.array_join(F.transform("x", lambda r: r["text"]), "\n").cast("binary")
    write_files(d.select(F.concat("lang", F.lit("/f"), "b", F.lit(".txt")).alias("path"), content.alias("content")), folder)
    return folder


@query("s2_zip_members", "SELECT lang || '/' || doc_id || '.txt' AS path, md5(coalesce(text, '')) AS content_md5 FROM documents")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    write_files(_archives(spark, sf_dir), folder)
    return archives.zip_members(spark, folder).select("path", F.md5("content").alias("content_md5"))


@query("s3_bad_members", "SELECT 'a' || doc_id // 50 || '.zip' AS archive, lang || '/' || doc_id || '.txt' AS member FROM documents WHERE doc_id % 50 = 49 AND doc_id // 50 % 3 = 0")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of which every third has a member whose checksum was changed."""

    def spoilt(path: str, raw: bytes) -> bytes:
        number = int(re.findall(r"\d+", path)[0])
        if number % 3:
            return raw
        raw = bytearray(raw)
        at = 0
        while (at := raw.find(b"PK\x01\x02", at)) >= 0:  # an entry of the directory: its checksum is at 16, its name at 46
            name = bytes(raw[at + 46 : at + 46 + struct.unpack_from("<H", raw, at + 28)[0]])
            if name.endswith(b"/%d.txt" % (50 * number + 49)):
                raw[at + 16] ^= 0xFF
            at += 4
        return bytes(raw)

    spoil = F.pandas_udf(lambda p, c: pd.Series([spoilt(x, y) for x, y in zip(p, c, strict=True)]), "binary")
    folder = new_folder(spark, "archives")
    write_files(_archives(spark, sf_dir).withColumn("content", spoil("path", "content")), folder)
    return archives.bad_members(spark, folder).select(F.substring_index("archive", "/", -1).alias("archive"), "member")


@query("s8_page_pieces", f"WITH v AS (SELECT page_id, {_VISIBLE} AS t FROM pages), s AS (SELECT page_id, t, unnest(range(0, length(t), 1200)) AS k FROM v) SELECT page_id, CAST(k // 1200 AS INT) AS part, md5(substr(t, CAST(k + 1 AS INT), 1200)) AS content_md5 FROM s")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents that aren't Markdown: what they show, in pieces by length."""
    shown = table(spark, sf_dir, "pages").select("page_id", C.visible_text(F.col("html")).alias("text"))
    return C.long_pieces(shown, "page_id", "text").select("page_id", "part", F.md5("content").alias("content_md5"))


@query("s9_json_batches", "SELECT CAST(doc_id AS VARCHAR) AS external_id, source, md5(text) AS content_md5 FROM documents")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON bodies with a list each, written, read back and taken apart."""
    d = table(spark, sf_dir, "documents")
    one = F.struct(F.col("doc_id").cast("string").alias("external_id"), "source", F.col("lang").alias("source_type"), F.concat(F.lit("d"), "doc_id").alias("title"), F.col("text").alias("content"))
    bodies = d.groupBy(F.floor(F.col("doc_id") / 50).alias("b")).agg(F.collect_list(one).alias("documents")).select("documents")
    folder = new_folder(spark, "json")
    bodies.write.json(folder)
    body = spark.read.schema(f"documents array<{ingest.BATCH_ROW}>").json(folder)
    return body.select(F.explode("documents").alias("d")).select("d.external_id", "d.source", F.md5("d.content").alias("content_md5"))


@query("k8_predictions", "SELECT conv_id * 1000 + turn AS question_id, text AS answer, role AS backend FROM conversations")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("answer"), F.col("role").alias("backend"))
    return archives.write_predictions(rows, new_folder(spark, "predictions"))


@query("c13_prefixes", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE substr('Document of ' || source || '.', 1, 800) END AS prefix, md5(CASE WHEN doc_id % 9 = 0 THEN substr(text, 1, 200) ELSE 'Document of ' || source || '.' || chr(10) || chr(10) || substr(text, 1, 200) END) AS index_md5 FROM documents")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that fails for some documents, whose chunks are then indexed without a prefix."""

    def provider(document: str, chunk: str) -> str:
        if not document:
            raise RuntimeError("no answer")
        return f" Document of {document}\x00. "

    about = F.when(F.col("doc_id") % 9 != 0, F.col("source"))
    d = table(spark, sf_dir, "documents").select("doc_id", about.alias("document"), F.substring("text", 1, 200).alias("content"))
    out = C.with_prefixes(d, provider, fail_open=True)
    return out.select("doc_id", "prefix", F.md5("index_content").alias("index_md5"))


@query("m13_outside_scores", "SELECT 'NOT_EXECUTED' AS status, 'ModuleNotFoundError' AS reason")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("text").alias("question"), F.lit("").alias("ground_truth"), F.lit("").alias("answer"), F.array().cast("array<string>").alias("contexts"))
    return E.outside_scores(rows).select("status", "reason")


@query("c2_section_paths", """WITH n AS (SELECT p_partkey, list_filter([trim(p_name), p_type, lower(p_type), p_brand], lambda x: x <> '') AS x FROM part)
SELECT p_partkey, array_to_string([x[i] FOR i IN range(1, len(x) + 1) IF i = 1 OR lower(x[i]) <> lower(x[i - 1])], ' > ') AS path FROM n""")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name as the title, its type in two spellings and its brand as the headings below it."""
    path = F.pandas_udf(lambda t, h: pd.Series([C.Chunker.path(x or "", list(y)) for x, y in zip(t, h, strict=True)]), "string")
    return table(spark, sf_dir, "part").select("p_partkey", path("p_name", F.array("p_type", F.lower("p_type"), "p_brand")).alias("path"))


@query("c4_hard_cuts", "WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, length(t), 500)) AS k FROM t) SELECT doc_id, CAST(k // 500 AS INT) AS part, md5(substr(t, CAST(k + 1 AS INT), 500)) AS content_md5 FROM s")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a place to break at, counted by characters: each piece is as long as it may be."""
    cut = F.pandas_udf(lambda t: pd.Series([list(C.Chunker(500, 0, len).cut(x)) for x in t]), "array<string>")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]", "")
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut(letters)).alias("part", "content"))
    return pieces.select("doc_id", "part", F.md5("content").alias("content_md5"))


@query("c7_chunk_limits", "SELECT doc_id, doc_id % 64 >= 32 AND doc_id % 80 < doc_id % 64 AS allowed FROM documents")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a chunker takes a size and an overlap, for those that the documents' numbers give."""

    def takes(most: int, overlap: int) -> bool:
        try:
            return C.Chunker(most, overlap).most == most
        except ValueError:
            return False

    allowed = F.pandas_udf(lambda m, o: pd.Series([takes(int(x), int(y)) for x, y in zip(m, o, strict=True)]), "boolean")
    return table(spark, sf_dir, "documents").select("doc_id", allowed(F.col("doc_id") % 64, F.col("doc_id") % 80).alias("allowed"))


@query("k6_vector_store_calls", "SELECT doc_id AS id, true AS small FROM documents")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added to a store that refuses more than ten at once."""
    from quern.operators.providers import add_to_store

    class Store:
        def add(self, ids: list, texts: list[str]) -> None:
            if not 0 < len(ids) == len(texts) <= 10:
                raise ValueError("one to ten texts a call")

    return add_to_store(table(spark, sf_dir, "documents"), "doc_id", "text", Store).select("id", (F.col("size") <= 10).alias("small"))


def _database(rows: DataFrame, name: str) -> Database:
    """The database with rows as its table `name`: the one that spark.quern.jdbc.url names; without it, one in memory where
    driver and tasks are one JVM, else a sealed one."""
    spark = rows.sparkSession
    url, master = spark.conf.get("spark.quern.jdbc.url", None), spark.sparkContext.master
    if url is None and master != "local" and not master.startswith("local["):
        return sealed(rows, name)
    db = in_memory() if url is None else Database(url)
    db.write(rows, name)
    return db


@query("s11_database_table", "SELECT doc_id, lang, n_chars FROM documents")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' numbers as a database table, read back in ranges of its key."""
    name = f"d{uuid.uuid4().hex}"
    return _database(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), name).table(spark, name, "doc_id")


@query("s12_search_replica", "SELECT item_id, text FROM benchmark WHERE item_id >= 3")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a table of the search replica; the filter is the database's work."""
    name = f"b{uuid.uuid4().hex}"
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return replica(_database(items, name)).table(spark, name).filter("item_id >= 3")


_TOKENS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'open sesame' WHEN 1 THEN 'Open Sesame' WHEN 2 THEN source END AS token FROM documents"


@query("f5_admin_gate", f"WITH t AS ({_TOKENS}) SELECT doc_id, coalesce(token = 'open sesame', false) AS allowed, false AS without_token FROM t")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each document; a server without a token lets none in."""
    asked = spark.sql(_TOKENS.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents"))
    return asked.select("doc_id", admin_allowed("open sesame", F.col("token")).alias("allowed"), admin_allowed(" ", F.col("token")).alias("without_token"))


@query(
    "t3_answer_frames",
    f"""WITH {LISTS}, h AS (SELECT b.item_id AS query_id, coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.rank), '') AS ids, count(a.id) AS n FROM benchmark b LEFT JOIN a ON a.query_id = b.item_id GROUP BY b.item_id),
p AS (SELECT item_id AS query_id, unnest(range(1, len(string_split(text, '. ')) + 1)) AS n, string_split(text, '. ') AS x FROM benchmark),
f AS (SELECT query_id, 0 AS o, 0 AS n, 'sources' AS kind, ids AS payload FROM h UNION ALL SELECT query_id, 1, n, 'text', x[n] FROM p UNION ALL SELECT query_id, 2, 0, 'metrics', 'hits=' || n FROM h)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, n) AS INT) AS place, kind, payload FROM f""",
)
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's hits, its sentences as an answer, and the number of hits."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = _lexical(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x"))
    found = items.join(hits, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("x", lambda s: s["id"].cast("string")), ","), F.lit("")).alias("ids"), F.coalesce(F.size("x"), F.lit(0)).alias("hits"))
    found = found.withColumn("hits", F.greatest("hits", F.lit(0)))
    parts = items.select("query_id", F.posexplode(F.split("text", r"\. ")).alias("n", "payload"))
    return answer_frames(found.select("query_id", F.col("ids").alias("payload")), parts, found.select("query_id", F.concat(F.lit("hits="), "hits").alias("payload")))
