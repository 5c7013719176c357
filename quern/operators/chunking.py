"""Chunking: structure-aware and token-bounded, Markdown knowledge files, and the relational window forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"\s{0,3}(#{1,6})\s+(.+?)\s*$")
_FENCE = re.compile(r"\s*(```|~~~)")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_STOPS = frozenset(".!?。！？;；")


_HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_ONE_HAN, _TOKEN = re.compile(f"[{_HAN}]"), re.compile(f"[{_HAN}]|[^\\s{_HAN}]+")


def words(text: str) -> int:
    """The default token counter: Han characters one by one, and other words between white space."""
    if text.isascii() or not _ONE_HAN.search(text):
        return len(text.split())
    return sum(1 for _ in _TOKEN.finditer(text))


class Vocabulary:
    """A token counter over a vocabulary file of the tokenizers library, loaded in each process that counts."""

    def __init__(self, path: str):
        self.path, self.encoder = path, None

    def __call__(self, text: str) -> int:
        if self.encoder is None:
            from tokenizers import Tokenizer

            self.encoder = Tokenizer.from_file(self.path)
        return len(self.encoder.encode(text, add_special_tokens=False).ids)

    def __reduce__(self):
        return Vocabulary, (self.path,)


def longest(size: int, fits: Callable[[int], bool], guess: int) -> int:
    """The largest length up to `size` that fits, at least 1: first by doubling a guess, then by halving what is left, so that
    no more is measured than a few times the answer."""
    low, high = 1, max(1, min(guess, size))
    while high < size and fits(high):
        low, high = high, min(size, 2 * high)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits(mid) else (low, mid - 1)
    return low


@dataclass(frozen=True)
class Chunker:
    """Splits at headings and blank lines, then by tokens, and packs neighbours of one section."""

    most: int = 700
    overlap: int = 80
    count: Callable[[str], int] = words

    def __post_init__(self) -> None:
        if self.most < 32:
            raise ValueError("a chunk holds 32 tokens at least")
        if not 0 <= self.overlap < self.most:
            raise ValueError("the overlap must be smaller than a chunk")

    def fingerprint(self) -> str:
        return f"structure-token-v2:max-{self.most}:overlap-{self.overlap}"

    def blocks(self, text: str, title: str) -> Iterator[tuple[str, str]]:
        """(section path, block): blocks end at headings and, outside of code fences, at blank lines."""
        trail: dict[int, str] = {}
        held: list[str] = []
        fence, path = None, title.strip()

        def block() -> Iterator[tuple[str, str]]:
            whole = "\n".join(held).strip()
            held.clear()
            if whole:
                yield path, whole

        for line in text.split("\n"):
            heading = None if fence else _HEADING.fullmatch(line)
            if heading:
                yield from block()
                level = len(heading[1])
                trail = {k: v for k, v in trail.items() if k < level} | {level: heading[2].strip()}
                path = self.path(title, [trail[k] for k in sorted(trail)])
                held.append(line)
            elif fence is None and not line.strip():
                yield from block()
            else:
                held.append(line)
                mark = _FENCE.match(line)
                if mark and fence in (None, mark[1]):
                    fence = None if fence else mark[1]
        yield from block()

    @staticmethod
    def path(title: str, headings: list[str]) -> str:
        names = [title.strip()] if title.strip() else []
        for h in headings:
            if h and not (names and names[-1].lower() == h.lower()):
                names.append(h)
        return " > ".join(names)

    def pieces(self, block: str) -> Iterator[str]:
        """A block that is too long, in runs of whole sentences; a sentence that is too long is cut."""
        if self.count(block) <= self.most:
            yield block
            return
        run = ""
        for sentence in filter(None, map(str.strip, _SENTENCE_END.split(block))):
            joined = f"{run} {sentence}".strip()
            if self.count(joined) <= self.most:
                run = joined
                continue
            if run:
                yield run
            run = sentence
            if self.count(sentence) > self.most:
                run = ""
                yield from self.cut(sentence)
        if run:
            yield run

    def cut(self, text: str) -> Iterator[str]:
        """The longest prefixes within the budget, moved back to white space or a stop in their last third. Each is found from
        a guess of its own size, so the work is in proportion to the text."""
        at = 0
        while at < len(text):
            size = longest(len(text) - at, lambda n: self.count(text[at : at + n]) <= self.most, 4 * self.most)
            end = at + size
            if end < len(text):
                ends = (k for k in range(end, at + int(size * 0.7), -1) if text[k - 1].isspace() or text[k - 1] in _STOPS)
                end = next(ends, end)
            if part := text[at:end].strip():
                yield part
            at = end

    def tail(self, text: str, budget: int) -> str:
        """The end of a text within the budget. It begins after the first white space or stop of its first third (24 characters
        at least); where there is none, as in text without spaces, it begins where the budget does."""
        if budget <= 0 or not text or self.count(text[-1]) > budget:
            return ""
        size = longest(len(text), lambda n: self.count(text[len(text) - n :]) <= budget, 4 * budget)
        start = len(text) - size
        whole = start == 0 or text[start - 1].isspace() or text[start - 1] in _STOPS
        if not whole:
            breaks = (k + 1 for k in range(start, min(len(text) - 1, start + max(24, size // 3))) if text[k].isspace() or text[k] in _STOPS)
            start = next(breaks, start)
        return text[start:].strip()

    def lead(self, before: str, piece: str) -> str:
        """A piece with as much of what is before it as the overlap and the budget leave room for."""
        room = min(self.overlap, self.most - self.count(piece))
        while room > 0 and (kept := self.tail(before, room)):
            whole = f"{kept}\n\n{piece}"
            if (excess := self.count(whole) - self.most) <= 0:
                return whole
            room -= excess
        return piece

    def chunks(self, text: str, title: str) -> Iterator[tuple[str, str]]:
        """(section path, content) of each chunk."""
        section, run = "", ""
        for path, block in self.blocks(text, title):
            for piece in self.pieces(block):
                joined = f"{run}\n\n{piece}" if run and path == section else piece
                if run and (path != section or self.count(joined) > self.most):
                    yield section, run.strip()
                    joined = self.lead(run, piece) if path == section else piece
                section, run = path, joined
        if run:
            yield section, run.strip()


def chunk_documents(docs: DataFrame, chunker: Chunker, id_col: str = "id", text_col: str = "content", title_col: str = "title") -> DataFrame:
    """id, chunk_index, section_path, content and token_count for each chunk, a document at a time in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, text, title in zip(pdf["id"], pdf["text"], pdf["title"], strict=True):
                out += [(id_, i, path, content, chunker.count(content)) for i, (path, content) in enumerate(chunker.chunks(text or "", title or ""))]
            yield pd.DataFrame(out, columns=["id", "chunk_index", "section_path", "content", "token_count"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(title_col).alias("title"))
    return rows.mapInPandas(run, "id string, chunk_index int, section_path string, content string, token_count int")


# ---------------------------------------------------------------- Markdown knowledge files

# Words of a section's name and the category that they stand for, first match first.
CATEGORIES = [
    (["趋势", "热门仓库", "Trend"], "trends"),
    (["基本信息"], "basic"),
    (["教育"], "education"),
    (["职业生涯", "工作经历"], "career"),
    (["项目"], "projects"),
    (["技术栈", "能力"], "skills"),
    (["职业定位"], "positioning"),
    (["职业目标"], "goals"),
    (["兴趣"], "interests"),
    (["理念", "性格"], "personality"),
]


def category(section: Column) -> Column:
    out = None
    for names, value in CATEGORIES:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(section, F.lit(n))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise("general")


def split_long(text: str, most: int) -> list[str]:
    """Paragraphs packed up to `most` characters; a longer one in fixed windows."""
    out, run = [], ""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if run and (len(run) + len(p) + 2 > most or len(p) > most):
            out.append(run)
            run = ""
        if len(p) > most:
            out += [p[i : i + most] for i in range(0, len(p), most)]
        else:
            run = f"{run}\n\n{p}" if run else p
    return out + ([run] if run else [])


def long_pieces(rows: DataFrame, id_col: str, text_col: str, most: int = 1200) -> DataFrame:
    """id, part and content: the pieces of each text by split_long; blank texts have none."""
    pieces = F.pandas_udf(lambda t: pd.Series([split_long(x or "", most) for x in t]), "array<string>")
    return rows.select(F.col(id_col), F.posexplode(pieces(F.col(text_col))).alias("part", "content"))


def split_markdown(text: str, most: int = 1200) -> Iterator[tuple[str, str, str, str, dict[str, str]]]:
    """(title, section, subsection, piece, front matter): ## starts a section, ### a part of it, # names the file.
    Parts that hold no more than headings and rules are left out."""
    meta: dict[str, str] = {}
    lead = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", text, re.DOTALL)
    if lead:
        for line in lead[1].split("\n"):
            key, sep, value = line.partition(":")
            if sep and key.strip() and value.strip():
                meta[key.strip()] = value.strip()
        text = text[lead.end() :]
    title, section, part = "", "概览", ""
    groups: list[tuple[str, str, list[str]]] = [(section, part, [])]
    for line in text.splitlines():
        h = re.fullmatch(r"(#{1,3})\s+(.+)", line)
        if h and len(h[1]) == 1:
            title = h[2].strip()
            continue
        if h:
            section, part = (h[2].strip(), "") if len(h[1]) == 2 else (section, h[2].strip())
            groups.append((section, part, []))
        groups[-1][2].append(line)
    for section, part, lines in groups:
        if any(x.strip() and not re.fullmatch(r"#{1,3}\s+.+|---+", x) for x in lines):
            for piece in split_long("\n".join(lines), most):
                yield title, section, part, piece, meta


def knowledge_chunks(files: DataFrame, most: int = 1200, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The chunks of Markdown files with what retrieval asks of them: category, topic, project, keywords, ids and dates.

    In a trend file, sections other than the snapshot itself take the analysis dates where the file gives them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, text in zip(pdf["source"], pdf["text"], strict=True):
                last, part = None, 0
                for n, (title, section, sub, piece, meta) in enumerate(split_markdown(text or "", most)):
                    part = part + 1 if (section, sub) == last else 0
                    last = (section, sub)
                    out.append((source, n, part, title, section, sub, piece, meta))
            yield pd.DataFrame(out, columns=["source", "chunk_index", "chunk_part", "title", "section", "subsection", "content", "front_matter"])

    fields = "source string, chunk_index int, chunk_part int, title string, section string, subsection string, content string, front_matter map<string,string>"
    rows = files.select(F.col(source_col).alias("source"), F.col(text_col).alias("text")).mapInPandas(run, fields)
    lead = lambda k: F.col("front_matter").getItem(k)
    trend = F.coalesce(lead("document_type") == "github_trend", F.lit(False))
    analysis = trend & ~F.contains("section", F.lit("自动快照"))
    topic = F.when(F.trim("subsection") == "", F.col("section")).otherwise(F.col("subsection"))
    rows = rows.withColumn("category", F.when(trend, "trends").otherwise(category(F.col("section")))).withColumn("topic", topic)
    return rows.select(
        "*",
        F.when(F.col("category") == "projects", F.col("subsection")).otherwise("").alias("project"),
        F.concat_ws(",", "category", "section", "topic").alias("keywords"),
        F.concat("source", F.lit(":"), "chunk_index").alias("chunk_id"),
        F.when(analysis, F.coalesce(lead("analysis_date"), lead("snapshot_date"))).otherwise(lead("snapshot_date")).alias("snapshot_date"),
        F.when(analysis, F.coalesce(lead("analysis_expires_at"), lead("expires_at"))).otherwise(lead("expires_at")).alias("expires_at"),
    )


# ---------------------------------------------------------------- relational forms


def window_chunks(docs: DataFrame, most: int, overlap: int, id_col: str, text_col: str) -> DataFrame:
    """Windows of `most` words that start every most - overlap words; none starts within the last one's overlap."""
    listed = docs.select(F.col(id_col).alias("id"), F.filter(F.split(text_col, r"\s+"), lambda x: x != "").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(most - overlap))
    out = listed.filter(F.size("w") > 0).withColumn("start", F.explode(starts)).filter((F.col("start") == 0) | (F.col("start") + overlap < F.size("w")))
    return out.select("id", "start", F.array_join(F.slice("w", F.col("start") + 1, most), " ").alias("content"))


def fixed_windows(docs: DataFrame, chars: int, id_col: str, text_col: str) -> DataFrame:
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(chars))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.posexplode(starts).alias("part", "start"))
    return out.select("id", "part", F.expr(f"substring(t, start + 1, {chars})").alias("content"))


def document_context(content: Column, chunk: Column, most: int) -> Column:
    """The document's head and a window about the chunk, `most` characters in all, with a mark between them."""
    head = most // 5
    rest = most - head
    at = F.greatest(F.lit(0), F.position(chunk, content) - 1)
    start = F.greatest(F.lit(head), at - rest // 2)
    end = F.least(F.length(content), start + rest)
    begin = F.greatest(F.lit(head), end - rest)
    window = content.substr(begin + 1, end - begin)
    return F.when(F.length(content) <= most, content).otherwise(F.concat(F.substring(content, 1, head), F.lit("\n\n[... document excerpt omitted ...]\n\n"), window))


def visible_text(html: Column) -> Column:
    """What a page shows, by patterns: comments, scripts and styles go, other tags are spaces, the five named entities and the
    hard space are characters again, and runs of white space are one space."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>", " ")
    plain = F.regexp_replace(plain, r"<[a-zA-Z/!?][^>]*>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n\f]+", " "))


def contextual_prefix(provider: Callable[[str, str], str], document: str, chunk: str, most: int = 800, fail_open: bool = False) -> str:
    """A provider's prefix for a chunk of a document: trimmed, without NUL characters, `most` characters at most. An empty answer
    is an error, and an error ends the ingestion, or with fail_open leaves the chunk without a prefix."""
    try:
        got = (provider(document, chunk) or "").replace("\x00", "").strip()
        if not got:
            raise ValueError("the provider gave no prefix")
        return got[:most].strip()
    except Exception:
        if not fail_open:
            raise
        return ""


def with_prefixes(chunks: DataFrame, provider: Callable[[str, str], str], document: str = "document", content: str = "content", most: int = 800, fail_open: bool = False) -> DataFrame:
    """chunks with prefix and index_content, a provider's call for each chunk."""
    if most < 100:
        raise ValueError("a prefix has room for 100 characters at least")

    @F.pandas_udf("string")
    def prefix(d: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([contextual_prefix(provider, x or "", y or "", most, fail_open) for x, y in zip(d, c, strict=True)])

    out = chunks.withColumn("prefix", prefix(F.col(document), F.col(content)))
    return out.withColumn("index_content", index_content(F.col("prefix"), F.col(content)))


def metadata_prefix(source: Column, title: Column, most: int = 500) -> Column:
    """The deterministic contextual prefix: what the chunk belongs to, without NUL characters."""
    return F.substring(F.replace(F.concat(F.lit("Source: "), source, F.lit(". Title: "), title, F.lit(".")), F.lit("\x00"), F.lit("")), 1, most)


def index_content(prefix: Column, content: Column) -> Column:
    return F.when(prefix == "", content).otherwise(F.concat(prefix, F.lit("\n\n"), content))
