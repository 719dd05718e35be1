"""Token ids in binary files: an independent zstandard frame a document, a trailing seek table, a checksum a frame.

A file is a valid zstandard stream in the public seekable layout:

    a frame a document      its ids, little-endian, 2 bytes each if the vocabulary allows it, else 4
    one skippable frame     the index: place of the file in the dataset, width, doc_ids
    one skippable frame     the seek table: compressed size, size and checksum of each frame above; its length; magic

A reader takes the seek table from the end of a file and then only the frames it was asked for. Documents are dealt
to tasks by ranges of doc_id and written in that order, so a dataset is one sequence of ids. Spark's own writer
commits the files (a file a row, ended by the magic number), so a task that is lost or run twice leaves nothing, and
any store that Spark writes to will do.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, keep_only, materialise, shuffle_partitions

#: Bytes of ids in a file (a larger document has a file of its own), level of compression.
FILE_BYTES, LEVEL = 16_000_000, 3
#: Texts encoded together; distinct words of a kind whose ids a worker remembers (forgetting them changes no result).
BLOCK_BYTES, WORDS = 4_000_000, 1_600_000
#: Fixed values of the seekable zstandard layout: magic numbers of the index, the seek table and the end of a file.
INDEX, SEEK, END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Appended to each document by the query.
END_ID = 0
#: A single space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Line ends between two such characters.
LINES = re.compile(r"(?<=\S)(\n+)(?=\S)")
MARKS = ".,;:!?"


class _Words(dict):
    """Ids of words after ``before``, as bytes; ``...`` stands for those of a word that it lacks, which is noted.

    If ``strict``, words that are empty or begin or end with white space have no ids (None). Words that were not asked
    for since the last ``turn`` but one are forgotten.
    """

    def __init__(self, before: str, strict: bool):
        super().__init__()
        self.before, self.strict, self.missing, self.old, self.marks = before, strict, [], {}, {}

    def __missing__(self, word: str):
        if word in self.old:
            ids = self[word] = self.old[word]
            return ids
        self.missing.append(word)
        return ...

    def turn(self) -> None:
        if len(self) > WORDS // 2:
            self.old = dict(self)
            self.clear()

    def learn(self, encode: Callable[..., list[bytes]]) -> None:
        new = list(dict.fromkeys(self.missing))
        self.missing.clear()
        if not self.strict:
            self.update(zip(new, encode([self.before + w for w in new])))
            return
        self.update((w, None) for w in new if not w or w[0].isspace() or w[-1].isspace())
        new = [w for w in new if w not in self]
        # a mark after a letter is a piece of its own, so words are encoded without it
        bare = {w: w[:-1] if w[-1] in MARKS and len(w) > 1 and w[-2].isascii() and w[-2].isalpha() else w for w in new}
        wanted = [w for w in dict.fromkeys(bare.values()) if w not in self and w not in self.old]
        apart = [w for w in wanted if "\n" in w]
        self.update(zip(apart, encode([self.before + w for w in apart])))
        lines = [w for w in wanted if "\n" not in w]  # many at a time
        for i in range(0, len(lines), 2000):
            part = lines[i : i + 2000]
            self.update(zip(part, encode(["".join(f"{self.before}{w}\n" for w in part)], len(part))))
        if not self.marks:
            self.marks = dict(zip(MARKS, encode(list(MARKS))))
        for w, short in bare.items():
            if w != short:
                self[w] = self[short] + self.marks[w[-1]]


class Encoder:
    """Encodes texts by a byte-level BPE file of the tokenizers library, each distinct word once.

    The pre-tokeniser always starts a new piece at a single space between two characters that are no white space, and at
    line ends between such; merges never cross pieces. So a text may be cut there, the parts encoded by the library,
    and their ids joined: the result is that of the whole text. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids
        (self.letter,) = self.library.encode("a", add_special_tokens=False).ids
        self.first, self.plain = _Words("", True), _Words(" ", True)
        self.loose_first, self.loose, self.runs = _Words("", False), _Words(" ", False), {}

    def _encode(self, texts: list[str], lines: int = 0) -> list[bytes]:
        """Ids of each text, or of each of the ``lines`` of one text: a line end is a piece of its own between words."""
        ids = [np.array(x.ids, self.kind) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        if lines:
            (all_,) = ids
            ends = np.flatnonzero(all_ == self.line_end)
            if len(ends) != lines:
                raise ValueError("the vocabulary merges line ends with words")
            starts = np.append(0, ends[:-1] + 1)
            ids = [all_[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        return [x.tobytes() for x in ids]

    def _run(self, ends: str) -> bytes:
        """Ids of line ends between two characters that are no white space."""
        if ends not in self.runs:
            ids = self.library.encode(ends + "a", add_special_tokens=False).ids
            if ids[-1] != self.letter:
                raise ValueError("the vocabulary merges line ends with words")
            self.runs[ends] = np.array(ids[:-1], self.kind).tobytes()
        return self.runs[ends]

    def _joined(self, segments: list[tuple[list[str], bytes]], first: _Words, later: _Words) -> list[bytes | None]:
        """Ids of segments from their parts, and what follows; None if a part has none."""
        found: list = [None] * len(segments)
        again = []
        for i, (parts, end) in enumerate(segments):
            known = len(first.missing) + len(later.missing)
            got = [first[parts[0]], *map(later.__getitem__, parts[1:]), end]
            if len(first.missing) + len(later.missing) > known:
                again.append(i)
                found[i] = got
            elif None not in got:
                found[i] = b"".join(got)
        first.learn(self._encode)
        later.learn(self._encode)
        for i in again:
            got, parts, at = found[i], segments[i][0], -1
            for _ in range(got.count(...)):
                at = got.index(..., at + 1)
                got[at] = later[parts[at]] if at else first[parts[0]]
            found[i] = None if None in got else b"".join(got)
        return found

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as bytes."""
        for words in (self.first, self.plain, self.loose_first, self.loose):
            words.turn()
        segments, owner = [], []
        for i, t in enumerate(texts):
            lines = LINES.split(t)
            for k in range(0, len(lines), 2):
                segments.append((lines[k].split(" "), self._run(lines[k + 1]) if k + 1 < len(lines) else self.end))
                owner.append(i)
        found = self._joined(segments, self.first, self.plain)
        # texts with white space beside a space are cut at other spaces only
        odd = sorted({owner[k] for k, x in enumerate(found) if x is None})
        loose = dict(zip(odd, self._joined([(CUT.split(texts[i]), self.end) for i in odd], self.loose_first, self.loose)))
        out: list[list[bytes]] = [[] for _ in texts]
        for k, i in enumerate(owner):
            if i not in loose:
                out[i].append(found[k])
        return [loose[i] if i in loose else b"".join(x) for i, x in enumerate(out)]


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int | None) -> Encoder:
    """This worker's, with the words it knows."""
    return Encoder(path, end_id)


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def packed(frames: list[tuple[bytes, int, int]], ids: list[int | None], at: tuple[int, int], width: int) -> bytes:
    """A whole file but for its last magic number. frames: each with the size and the checksum of what it holds."""
    null = np.array([i is None for i in ids], bool)
    numbers = np.array([0 if i is None else i for i in ids], "<i8")
    head = struct.pack("<BBQQQ", 1, width, *at, len(ids))
    index = skippable(INDEX, zstandard.ZstdCompressor(level=LEVEL).compress(head + numbers.tobytes() + np.packbits(null).tobytes()))
    entries = np.array([(len(f), n, c) for f, n, c in frames] + [(len(index), 0, 0)], "<u4")
    table = entries.tobytes() + struct.pack("<IB", len(entries), 0x80)
    return b"".join([*(f for f, _, _ in frames), index, struct.pack("<II", SEEK, len(table) + 4), table])


class TokenFile:
    """Random access to one file through ``read(start, size)``: only the frames asked for are read and decompressed."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != END or flags != 0x80:
            raise ValueError("not a token file")
        table = read(size - 9 - 12 * n - 8, 12 * n + 8)
        if struct.unpack("<II", table[:8]) != (SEEK, 12 * n + 9):
            raise ValueError("the seek table is broken")
        self.read, self.entries = read, np.frombuffer(table[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.cumsum(self.entries[:, 0]) - self.entries[:, 0]
        body = zstandard.ZstdDecompressor().decompress(read(int(self.starts[-1]) + 8, int(self.entries[-1, 0]) - 8))
        _, self.width, self.part, self.file, k = struct.unpack("<BBQQQ", body[:26])
        self.doc_ids = np.frombuffer(body[26 : 26 + 8 * k], "<i8")
        self.null = np.unpackbits(np.frombuffer(body[26 + 8 * k :], np.uint8))[:k].astype(bool)
        self.sizes = self.entries[:k, 1] // self.width

    def ids(self, i: int) -> np.ndarray:
        """Ids of the file's i-th document. Raises if its frame's checksum differs."""
        length, size, checksum = self.entries[i].tolist()
        raw = zstandard.ZstdDecompressor().decompress(self.read(int(self.starts[i]), length), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"the frame of document {self.doc_ids[i]} is broken")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of ``docs`` (doc_id, text) to a new folder ``path``, in ascending order of doc_id.

    Null texts count as empty; each document ends with ``end_id`` if given. Null ids come last. Rows that repeat an id
    are documents of their own, in the order of a hash of their texts. No rows give no files. Other columns are ignored.
    A document may have up to 4 GB of ids. ``file_bytes`` (of ids, before compression) changes no ids.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas would make ids beside nulls doubles

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("tokens", encoder.cache_clear)
        own, squeeze = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        part, file, size, frames, ids = TaskContext.get().partitionId(), 0, 0, [], []
        for doc_id, text in _rows(batches, own):
            if frames and size + len(text) > file_bytes:
                yield pd.DataFrame({"value": [packed(frames, ids, (part, file), own.kind.itemsize)]})
                file, size, frames, ids = file + 1, 0, [], []
            frames.append((squeeze.compress(text), len(text), xxhash.xxh64_intdigest(text) & 0xFFFFFFFF))
            ids.append(doc_id)
            size += len(text)
        if frames:
            yield pd.DataFrame({"value": [packed(frames, ids, (part, file), own.kind.itemsize)]})

    found = rows.mapInPandas(files, "value binary").select(F.col("value").cast("string"))
    end = struct.pack("<I", END).decode("latin-1")
    found.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", end).text(path)


def _rows(batches: Iterator[pd.DataFrame], own: Encoder) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and encoded text of each row, a few megabytes of text at a time."""
    for b in batches:
        ids, texts = b["doc_id"].tolist(), b["text"].tolist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK_BYTES):
                size += len(texts[j])
                j += 1
            for k, text in enumerate(own.texts(texts[i:j]), i):
                yield (None if ids[k] is None else int(ids[k])), text
            i = j


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[TokenFile]:
    for b in batches:
        for raw in b["content"]:
            if len(raw):
                yield TokenFile(lambda start, size, raw=raw: bytes(raw[start : start + size]), len(raw))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row a document, from the files: part, file, doc_id, start (ids before it in its file), n_tokens, ids_crc32 (of the ids as 4 bytes each, little-endian)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _opened(batches):
            crc = [zlib.crc32(f.ids(i).tobytes()) for i in range(len(f.sizes))]
            ids = pd.array(f.doc_ids, "Int64")
            ids[f.null] = pd.NA
            yield pd.DataFrame({"part": f.part, "file": f.file, "doc_id": ids, "start": np.cumsum(f.sizes) - f.sizes, "n_tokens": f.sizes, "ids_crc32": crc})

    return _files(spark, path).mapInPandas(each, "part long, file long, doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the asked documents; no other frame is decompressed."""
    wanted = np.array(sorted(doc_ids), np.int64)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _opened(batches):
            for i in np.flatnonzero(np.isin(f.doc_ids, wanted) & ~f.null):
                yield pd.DataFrame({"doc_id": [f.doc_ids[i]], "ids": [f.ids(i).astype(np.int64)]})

    return _files(spark, path).mapInPandas(each, "doc_id long, ids array<long>")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files."""
    found = materialise(catalogue(spark, path), "catalogue")
    files = found.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row a task of the writer
    offsets, at = [], 0
    for r in parts:
        offsets.append((r["part"], at))
        at += r["n"]
    before = F.broadcast(spark.createDataFrame(offsets, "part long, part_start long"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("file_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "part").select("part", "file", (F.col("part_start") + F.col("file_start")).alias("before"))
    return found.join(starts, ["part", "file"]).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    """The queries' vocabulary file: ``STRANDLOOM_TOKENIZER``, else the public byte-level one."""
    if found := os.environ.get("STRANDLOOM_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write(docs, path, default_tokenizer(), END_ID)
    return positions(spark, path)
