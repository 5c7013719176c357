"""What the corpus operators share: the shared folder, written tables, word hashes and cached tokenisation."""

from __future__ import annotations

import functools
import os
import re
import struct
import sys
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import new_folder, written

__all__ = ["new_folder", "written"]

#: A null id takes part as this value, so that it sorts first; results turn it back into null.
NULL_ID = -(2**63)


# ---------------------------------------------------------------- shared folder


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder or file in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:" + uri.removeprefix("file:"))


def put_file(uri: str, data: bytes) -> str:
    """Write a whole file under a name that no other attempt uses, and return it. Only names of finished tasks are read."""
    stem, dot, end = uri.rpartition("/")[2].partition(".")
    uri = f"{uri.rpartition('/')[0]}/{stem}-{uuid.uuid4().hex}{dot}{end}"
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


def put_named(uri: str, data: bytes) -> None:
    """Write a file under a given name, whole at once. All attempts write the same bytes, so the first one's file stays."""
    fs, path = filesystem(uri)
    part_path = filesystem(put_file(uri + ".tmp", data))[1]
    try:
        fs.move(part_path, path)
    except OSError:
        if fs.get_file_info(path).type.name != "File":
            raise
        fs.delete_file(part_path)


def ids(column: str) -> "F.Column":
    """The id column as a long without nulls."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def back(column: str) -> "F.Column":
    return F.when(F.col(column) != NULL_ID, F.col(column))


def text_of(column: str) -> "F.Column":
    """The text column; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def key_of(column: str) -> "F.Column":
    """A hash of the text. Rows with one id (or none) are told apart by it; rows that repeat both are the same document."""
    return F.xxhash64(text_of(column))


def keep_rows(docs: DataFrame, text_col: str, wanted: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows whose text is wanted, columns as they were: each is decided on where it is read, so neither its id nor
    another row with that id matters, and nothing is shuffled. Only texts go to the Python worker, so other columns may be of
    any type. `wanted` makes a task's judge of texts."""

    @F.arrow_udf("boolean")
    def keeps(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = wanted()
        for part in parts:
            slices = (part.slice(i, 512).to_pylist() for i in range(0, len(part), 512))
            yield pa.array([x for texts in slices for x in judge(texts)], pa.bool_())

    return docs.filter(keeps(text_of(text_col)))


def keep_keyed(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and text's hash are in kept (id, key), columns as they were."""
    i, k = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "key"))
    named = kept.select(F.col("id").alias(i), F.col("key").alias(k)).distinct()
    return docs.withColumns({i: ids(id_col), k: key_of(text_col)}).join(named, [i, k], "left_semi").drop(i, k)


# ---------------------------------------------------------------- words and hashes


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column's UTF-8 bytes; null is empty."""
    col = batch.column(name)
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def words_of(raw: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return raw.lower().split()


class WordHashes(dict):
    """word -> 64-bit hash. Of `limit` words those used since the last turnover stay; words of more than MOST_KEPT bytes are
    hashed each time. So memory is bounded in bytes, also for texts without spaces."""

    MOST_KEPT = 64

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.MOST_KEPT:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        h = self[word] = self.old.get(word) or xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_MULTIPLIER = 0x9E3779B97F4A7C15


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than `width` are one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(width, n)
    acc = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        acc = acc * np.uint64(_MULTIPLIER) + hashes[i : n - w + 1 + i]
    return np.unique(mix(acc))


# ---------------------------------------------------------------- tokenisation


def little(numbers: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return array("I", numbers).tobytes() if _NATIVE else struct.pack(f"<{len(numbers)}I", *numbers)


_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


class _Pieces(dict):
    """Ids of pieces, with a space before them or without. Of `limit` bytes of pieces those used since the last turnover
    stay; pieces of more than MOST_KEPT characters, such as texts without spaces, are encoded each time. An entry takes
    about 200 bytes for its two objects and their places, and four for each character and its ids."""

    MOST_KEPT = 64
    def __init__(self, owner: "CachedEncoder", space: bool, limit: int):
        super().__init__()
        self.owner, self.half, self.old, self.held = owner, limit // 2, {}, 0
        self.space = " " if space else ""
        self.spelled = owner.spell(" ") if space and not owner.lowers else ""

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self._new(piece)
            if len(piece) > self.MOST_KEPT:
                return out
        self[piece] = out
        self.held += 200 + 4 * len(piece)
        if self.held > self.half:
            self.old, self.held = dict(self), 0
            self.clear()
        return out

    def _letters(self, piece: str) -> bytes:
        """Ids of Latin letters: one pre-token."""
        owner = self.owner
        if owner.lowers:
            piece = piece.lower()
        return little([t.id for t in owner.model.tokenize(self.spelled + piece.translate(owner.letters))])

    def _new(self, piece: str) -> bytes:
        owner = self.owner
        if piece.isalpha() and (piece.isascii() or max(piece) < "\u0100"):
            return self._letters(piece)
        if "<" in piece:  # it may hold the name of a special token
            return owner.encode(self.space + piece)
        at = piece.find("\n")
        if 0 < at < len(piece) - 1 and not piece[at - 1].isspace() and not piece[at + 1].isspace():
            return self.known(piece[:at]) + owner.line_feed + owner.initial.known(piece[at + 1 :])
        stem = piece.rstrip(_MARKS)
        if stem != piece and stem[-1:].isascii() and stem[-1:].isalpha():
            return self.known(stem) + owner.initial[piece[len(stem) :]]
        return owner.encode(self.space + piece)

    def known(self, piece: str) -> bytes:
        """As self[piece], but a new piece isn't stored: its whole is."""
        return self.get(piece) or self.old.get(piece) or self._new(piece)


class CachedEncoder:
    """Ids of whole texts by a tokenizers file, the same as encode() gives for the whole text.

    No token of the supported vocabularies spans the place between a character that isn't white space and a space or line
    feed, that between a lone line feed and what follows, or that between an ASCII letter and an ASCII mark; and their
    normalisers don't look across. So a text is cut there and each distinct piece is encoded once by the library; a
    piece of Latin letters is one pre-token, which goes to the library's model directly.
    """

    def __init__(self, path: str, limit: int = 300_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.lowers = "Lowercase(" in str(self.encoder.normalizer)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = lambda c: level.pre_tokenize_str(c)[0][0]
        self.letters = {n: self.spell(chr(n)) for n in range(256) if chr(n).isalpha()}
        self.line_feed = self.encode("\n")
        self.inner, self.initial = _Pieces(self, True, limit), _Pieces(self, False, limit // 8)

    def encode(self, text: str) -> bytes:
        return little(self.encoder.encode(text, add_special_tokens=False).ids)

    def ids_of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any([x in text for x in _PAIRS]):
            return b"".join([self.inner[x[1:]] if x[:1] == " " and x[1:].strip() else self.encode(x) for x in _CUT.split(text)])
        first, *rest = text.split(" ")
        return self.initial[first] + b"".join(map(self.inner.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> CachedEncoder:
    """The process's encoder for a vocabulary: a worker keeps its pieces from task to task."""
    return CachedEncoder(path)


_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: White space before a space: there a text can't simply be split at spaces.
_PAIRS = [c + " " for c in map(chr, range(0x10000)) if c.isspace()]
_CUT = re.compile(r"(?<=\S)(?= )")


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null is empty."""
    col = batch.column(name)
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = pc.cast(col, pa.string())
    return [x or "" for x in col.to_pylist()]
