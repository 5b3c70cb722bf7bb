"""Token-id files: one zstandard frame a document, a trailing seek table.

A file holds documents in ascending id.  Each frame decompresses on its own to
a document's ids (little-endian unsigned 32-bit, end id included).  After the
frames come two skippable frames that any zstandard reader passes over: the
document ids (64-bit), and a seek table in the public seekable layout, one entry
of compressed size, decompressed size and checksum (low 32 bits of XXH64) a
frame, then the number of frames, a descriptor byte and a magic number.  A
reader needs the table and the frames it is asked for, nothing else.

Texts are tokenized where they are read; what is shuffled to the files is the
compressed frames.  A file is written under a name of its own and renamed at the
end, so a repeated or lost attempt leaves at most a hidden file.
"""
from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, stretch_of, stretches

# fixed values of the zstandard seekable format
SKIPPABLE, SEEK_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
HAS_CHECKSUM = 0x80
LEVEL = 1
#: Characters encoded at once: a batch encodes each of its distinct words once.
BATCH_CHARS = 8_000_000
#: Bounds of a worker's cache of encoded pieces.
CACHE_PIECES, CACHE_BYTES = 500_000, 48
_TAIL = b".,;:!?*$#%&()[]\"|-"          # no apostrophe: it starts contractions


class Recent:
    """Remembered results; the half not asked for lately is forgotten."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        got, new, young, old = {}, [], self.young, self.old
        for p in wanted:
            ids = young.get(p)
            if ids is None:
                ids = old.get(p)
                if ids is None:
                    new.append(p)
                    continue
                young[p] = ids
            got[p] = ids
        if new:
            made = dict(zip(new, self.make(new)))
            got.update(made)
            young.update((p, x) for p, x in made.items() if len(p) <= CACHE_BYTES)
        if len(young) > self.most // 2:
            self.young, self.old = {}, young
        return got


class Encoder:
    """Ids of whole texts, piece by piece between ASCII white space.

    Made for tokenizers that drop white space and cut between letters and marks:
    a word that is all letters, also after the tokenizer's own normaliser, is encoded
    once and remembered, a tail of ASCII marks apart from it.  A word that the normaliser
    turns into letters and other signs (a dotted capital I, a letter with a nukta) is
    encoded with its tail.  What was not asked for lately is forgotten."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.lowers = self._each([b"QxZ"]) == self._each([b"qxz"])
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        #: Letters met, and those that the normaliser turns into something else than letters.
        self.met: set[str] = set()
        self.unsteady: set[str] = set()
        self.words, self.others, self.pieces = (
            Recent(f, CACHE_PIECES) for f in (self._words, self._each, self._pieces))

    def _each(self, pieces: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Words of letters at once: joined by spaces and cut where a word ends."""
        texts = [b" ".join(words[i:i + 500]).decode() for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):                          # some word is not one run of letters to the tokenizer
            return self._each(words)
        raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _letters(self, word: bytes) -> bool:
        """Is the word one run of letters to the tokenizer?"""
        if word.isascii():
            return word.isalpha()
        s = word.decode()
        if not s.isalpha():
            return False
        if not self.met.issuperset(s):
            new = set(s) - self.met
            self.met |= new
            self.unsteady.update(c for c in new if not self.normalize(c).isalpha())
        return self.unsteady.isdisjoint(s)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """A word of letters and a tail of ASCII marks apart, anything else as it is."""
        words, others, split = set(), set(), []
        for p in pieces:
            core = p.rstrip(_TAIL)
            if core and self._letters(core):
                core, tail = core.lower() if self.lowers else core, p[len(core):]
                words.add(core)
            else:
                core, tail = b"", p
            others.add(tail)
            split.append((core, tail))
        ids = {b"": b"", **self.words(words), **self.others(others)}
        return [ids[core] + ids[tail] for core, tail in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        cut = [(t or "").encode("utf-8", "replace").split() for t in texts]
        whole = self.pieces(set().union(*cut))
        return [b"".join(map(whole.__getitem__, t)) for t in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def frames(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, frame, checksum): the ids of every text as a frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack, end = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=LEVEL), struct.pack("<I", end_id)
        for b in batches:
            chars = np.asarray(pc.fill_null(pc.utf8_length(b.column(1)), 0))
            for rows in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(np.cumsum(chars) // BATCH_CHARS)) + 1):
                if not len(rows):
                    continue
                part = b.slice(int(rows[0]), len(rows))
                ids = [x + end for x in encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([pack.compress(x) for x in ids], pa.binary()),
                     pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in ids], pa.int64())],
                    names=["doc_id", "n_tokens", "frame", "checksum"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, frame binary, checksum long")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


MANIFEST = "file string, part int, first_doc long, n_docs long, n_tokens long"
#: Documents of a file, about (more where the number of files would pass its bound).
FILE_DOCS = 5000


class _Writer:
    """One file in the making, under a name of its own until it is closed."""

    def __init__(self, path: str, part: int):
        self.part, self.name = part, f"part-{part:06d}.zst"
        self.path, (self.fs, self.root) = path, _open(path)
        self.fs.create_dir(self.root, recursive=True)
        self.tmp = f"{self.root}/.{self.name}-{uuid.uuid4().hex}"
        self.out, self.ids, self.table, self.tokens = self.fs.open_output_stream(self.tmp), [], [], 0

    def add(self, doc_id: int, n: int, frame: bytes, check: int) -> None:
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table.append(struct.pack("<III", len(frame), 4 * n, check))
        self.tokens += n

    def close(self) -> pa.RecordBatch:
        self.out.write(_skippable(INDEX_MAGIC, np.array(self.ids, "<i8").tobytes()))
        tail = struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEK_MAGIC)
        self.out.write(_skippable(SKIPPABLE, b"".join(self.table) + tail))
        self.out.close()
        self.fs.move(self.tmp, f"{self.root}/{self.name}")
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{self.path}/{self.name}"]), pa.array([self.part], pa.int32()), pa.array([self.ids[0]], pa.int64()),
             pa.array([len(self.ids)], pa.int64()), pa.array([self.tokens], pa.int64())],
            names=["file", "part", "first_doc", "n_docs", "n_tokens"])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the files below ``path`` (any file system that all nodes reach) and
    returns the manifest: file, part (files in ascending doc_id), first_doc,
    n_docs, n_tokens; the files are written when it is.  Null texts are empty: just
    the end id.  Null ids come first and are kept as the least 64-bit number; rows
    that repeat an id are ordered by their ids' bytes; an empty table makes no file."""
    part = stretch_of(F.col("doc_id"), stretches(docs, file_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for p, d, n, frame, check in zip(*(b.column(k).to_pylist() for k in range(5))):
                if out is not None and out.part != p:
                    yield out.close()
                    out = None
                out = out or _Writer(path, p)
                out.add(d, n, frame, check)
        if out is not None:
            yield out.close()

    made = frames(docs.select(id_key().alias("doc_id"), "text"), tokenizer, end_id).select(
        part.alias("part"), "doc_id", "n_tokens", "frame", "checksum")
    return (made.repartition("part").sortWithinPartitions("part", "doc_id", "checksum", "n_tokens", "frame")
            .mapInArrow(run, MANIFEST))


class File:
    """Random access to one file: ``ids``, and ``read(i)`` of the i-th document."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUM:
            raise ValueError(f"{uri}: no seek table")
        at = size - 9 - 12 * n
        entries = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(-1, 3)
        self.sizes, self.lengths, self.checks = entries.T.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.frombuffer(self.file.read_at(8 * n, int(self.starts[-1]) + 8), "<i8")

    def read(self, i: int) -> bytes:
        frame = self.file.read_at(int(self.sizes[i]), int(self.starts[i]))
        out = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, int(self.lengths[i])))
        if len(out) != self.lengths[i] or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"document {self.ids[i]}: its frame does not match its checksum")
        return out


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, from the files.
    start: ids of all documents before it, in ascending doc_id.  ``manifest`` has a
    row a file; it is collected to add up where each file starts."""
    start, rows = 0, []
    for r in manifest.select("part", "file", "n_tokens").orderBy("part").collect():
        rows.append((r["file"], start))
        start += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = File(file)
                for i in range(0, len(f.ids), 256):
                    got = [f.read(j) for j in range(i, min(i + 256, len(f.ids)))]
                    n = [len(x) // 4 for x in got]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.ids[i:i + len(got)]), pa.array(at + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)),
                         pa.array(n, pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at += sum(n)

    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.createDataFrame(rows, "file string, at long").repartition(len(rows))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
