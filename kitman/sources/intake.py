"""Document intake (S01–S05): bytes → guarded, decoded, identified rows.

``intake_files`` lists the files below a folder and reads the text files within the
size limit only, so an oversize file is never read.  Where the workers mount the file
system, tasks list the folders, and the files are dealt out to tasks by their number
and bytes.  Elsewhere, and for a stream, the ``binaryFile`` source looks at files
twice: once without their content, for those that are turned away, and once for the
others, by name and by a filter on ``length`` that Spark pushes into the source.  Any
table with (path, length, content) columns goes through the same guards and decoding
(``intake``).
Note: ``binaryFile`` skips zero-byte files, so 'empty' only fires on table
input.  PDF text extraction is not built: accepted ``.pdf`` rows are routed
to quarantine as ``pdf_text_required`` (text must arrive extracted).
"""
from __future__ import annotations

import errno
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..session import ensure_checkpoint_dir, shared_folder

INTAKE_COLUMNS = ["path", "filename", "length", "reject_reason", "document_id", "text"]


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .load(path).select("path", "length", "content"))


def filename_of(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(R.DEFAULT_FILENAME)).otherwise(name)


def reject_reason(length: Column, filename: Column, max_bytes: int = R.MAX_UPLOAD_BYTES) -> Column:
    """S03, in order: empty → too_large (strictly above the limit) →
    unsupported_type (case-insensitive .pdf/.txt); null = accepted."""
    low = F.lower(filename)
    ok_ext = None
    for ext in R.ALLOWED_EXTENSIONS:
        c = low.endswith(ext)
        ok_ext = c if ok_ext is None else ok_ext | c
    return (F.when(F.coalesce(length, F.lit(0)) == 0, "empty")
            .when(length > max_bytes, "too_large")
            .when(~ok_ext, "unsupported_type"))


def decode_utf8(content: Column) -> Column:
    """Bytes → text, invalid sequences → U+FFFD (never raises)."""
    return F.make_valid_utf8(content.cast("string"))


def document_id_for(path: Column, content: Column, width: int = R.ID_HEX_WIDTH) -> Column:
    """Deterministic id from path + bytes, so a retried task or a
    re-run yields the same id (width is a parameter: 10 hex = 40 bits)."""
    digest = F.sha2(F.concat(F.encode(path, "UTF-8"), content), 256)
    return F.concat(F.lit(R.DOC_ID_PREFIX), F.substring(digest, 1, width))


def valid_document_id(doc_id: Column, width: int = R.ID_HEX_WIDTH) -> Column:
    """``^doc_[0-9a-f]{width}$``."""
    return F.coalesce(doc_id.rlike(f"^{R.DOC_ID_PREFIX}[0-9a-f]{{{width}}}$"), F.lit(False))


def intake(raw: DataFrame, max_bytes: int = R.MAX_UPLOAD_BYTES, id_width: int = R.ID_HEX_WIDTH) -> DataFrame:
    """(path, length, content) → guarded rows; accepted rows carry id + text.
    ``id_width``: hex digits of the ids (4 bits each; up to 64).  10 suit one
    service; a corpus of n documents wants about 2 log16(n) + 10."""
    fname = filename_of(F.col("path"))
    reason = reject_reason(F.col("length"), fname, max_bytes)
    is_pdf = F.lower(fname).endswith(".pdf")
    reason = F.coalesce(reason, F.when(is_pdf, F.lit("pdf_text_required")))
    accepted = reason.isNull()
    return raw.select(
        "path", fname.alias("filename"), F.col("length").cast("long").alias("length"),
        reason.alias("reject_reason"),
        F.when(accepted, document_id_for(F.col("path"), F.col("content"), id_width)).alias("document_id"),
        F.when(accepted, decode_utf8(F.col("content"))).alias("text"))


#: Names of files whose text is read.
TEXT_FILES = "*.[tT][xX][tT]"


def _files(reader, path: str, recursive: bool, glob: str | None = None) -> DataFrame:
    reader = reader.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _guarded(reader_of, path: str, max_bytes: int, id_width: int, recursive: bool) -> DataFrame:
    unread = _files(reader_of(), path, recursive).select("path", "length", F.lit(None).cast("binary").alias("content"))
    within = _files(reader_of(), path, recursive, TEXT_FILES).filter(F.col("length").between(1, max_bytes)).select("path", "length", "content")
    return quarantined(intake(unread, max_bytes, id_width)).unionByName(accepted(intake(within, max_bytes, id_width)))


# -- files that the workers mount --------------------------------------------------
# ``binaryFile`` lists all files in the driver, twice here, and a task of it reads
# about 32 small files, however many there are.

#: Files, and bytes, that a task reads; bytes of a batch.
TASK_FILES, TASK_BYTES, BATCH_BYTES = 20_000, 64 << 20, 8 << 20
#: Names that a task lists before it leaves the folders it finds to other tasks.
LIST_NAMES = 10_000

_LISTED = "path string, length long"
_PASSED_OVER = {errno.ENOENT, errno.ENOTDIR, errno.EACCES, errno.ELOOP, errno.ENAMETOOLONG}


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as the workers see it, or None: another file system, a file, a
    pattern, or settings that only Spark's own sources know."""
    if any(c in path for c in "{}[]*?\\") or any(
            spark.conf.get(f"spark.sql.files.{x}") == "true" for x in ("ignoreMissingFiles", "ignoreCorruptFiles")):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() != "file" or not fs.isDirectory(p):
        return None
    try:
        ensure_checkpoint_dir(spark)                        # the list of files is kept there
    except RuntimeError:
        return None
    return fs.makeQualified(p).toUri().getPath()


def _hidden(name: str, folder: bool) -> bool:
    """As Spark's sources have it."""
    if name.startswith(".") or name.startswith("_") and "=" not in name:
        return not (folder and name.startswith(("_metadata", "_common_metadata")))
    return name.endswith("._COPYING_") and not name.startswith(("_metadata", "_common_metadata"))


def _entries(folder: str) -> Iterator[tuple[str, int | None]]:
    """Paths and lengths of the files in the folder; of a folder the length is None."""
    with os.scandir(folder) as found:
        for e in found:
            try:
                e.name.encode()
                folder_too = e.is_dir()
                length = None if folder_too else e.stat().st_size
            except UnicodeEncodeError:                      # Hadoop passes over these too, as over what is
                continue                                    # gone meanwhile, closed to us or a link to nowhere
            except OSError as x:
                if x.errno not in _PASSED_OVER:
                    raise
                continue
            if length != 0 and not _hidden(e.name, folder_too):
                yield f"{folder.rstrip('/')}/{e.name}", length


def _listed(spark: SparkSession, base: str) -> DataFrame:
    """(path, length) of all files below the folder, as they are now."""
    most = LIST_NAMES

    def rows(folders: Iterator[str]) -> Iterator[tuple[str, int | None]]:
        seen = 0
        for given in folders:
            below = [given]
            while below:
                for path, length in _entries(below.pop()):
                    seen += 1
                    if length is None and seen < most:
                        below.append(path)
                    else:
                        yield path, length
                if seen >= most:
                    yield from ((x, None) for x in below)
                    below = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, lengths = [], []
        full = lambda: pa.record_batch({"path": pa.array(paths, pa.string()), "length": pa.array(lengths, pa.int64())})
        for path, length in rows(x for b in batches for x in b.column(0).to_pylist()):
            paths.append(path)
            lengths.append(length)
            if len(paths) == 10_000:
                yield full()
                paths, lengths = [], []
        yield full()

    # by a name that the listing passes over, should it lie below the folder
    at, levels = shared_folder(spark, "_files"), []
    folders, n = spark.createDataFrame([(base,)], "path string"), 1
    while n:
        tasks = max(min(n, 4 * spark.sparkContext.defaultParallelism), n // 1000)
        levels.append(f"{at}/{len(levels)}")
        folders.repartition(tasks).mapInArrow(run, _LISTED).write.parquet(levels[-1])
        folders = spark.read.schema(_LISTED).parquet(levels[-1]).filter("length IS NULL").select("path")
        n = folders.count()
    return spark.read.schema(_LISTED).parquet(*levels).filter("length IS NOT NULL")


def _check(path: str, data: bytes) -> None:
    """The checksums that Hadoop keeps beside the files it writes on a local file system."""
    folder, name = os.path.split(path)
    try:
        with open(f"{folder}/.{name}.crc", "rb", buffering=0) as f:
            sums = f.readall()
    except OSError:
        return
    each = int.from_bytes(sums[4:8], "big")
    if sums[:4] != b"crc\0" or not each:
        return
    if sums[8:] != b"".join(zlib.crc32(data[i:i + each]).to_bytes(4, "big") for i in range(0, len(data), each)):
        raise OSError(f"checksum error: {path}")


def _read(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files (path, length) with their content, of those that are still within the limit."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, 2 * files.sparkSession.sparkContext.defaultParallelism), -(-n // TASK_FILES), -(-size // TASK_BYTES))
    most = BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, lengths, contents, held = [], [], [], 0
        full = lambda: pa.record_batch({"path": pa.array(paths, pa.string()), "length": pa.array(lengths, pa.int64()),
                                        "content": pa.array(contents, pa.binary())})
        for path in (x for b in batches for x in b.column(0).to_pylist()):
            with open(path, "rb", buffering=0) as f:
                length, data = os.fstat(f.fileno()).st_size, None
                if length <= max_bytes:
                    data = f.readall()
                    length = len(data)
                    _check(path, data)
            paths.append(path)
            lengths.append(length)
            contents.append(data if length <= max_bytes else None)
            held += len(data or b"")
            if held >= most or len(paths) == 10_000:
                yield full()
                paths, lengths, contents, held = [], [], [], 0
        yield full()

    return files.select("path").repartition(tasks).mapInArrow(run, f"{_LISTED}, content binary")


def _mounted_files(spark: SparkSession, base: str, max_bytes: int, id_width: int) -> DataFrame:
    files = _listed(spark, base)
    wanted = F.col("length").between(1, max_bytes) & F.lower("path").endswith(".txt")
    found = files.filter(~wanted).withColumn("content", F.lit(None).cast("binary")).unionByName(_read(files.filter(wanted), max_bytes))
    return intake(found.withColumn("path", F.concat(F.lit("file:"), "path")), max_bytes, id_width)


def intake_files(spark: SparkSession, path: str, max_bytes: int = R.MAX_UPLOAD_BYTES, id_width: int = R.ID_HEX_WIDTH,
                 recursive: bool = True) -> DataFrame:
    """The rows of ``intake`` for the files below ``path``; the bytes of a file
    that is turned away (too large, another type, empty) are not read."""
    base = _mounted(spark, path) if recursive else None
    if base:
        return _mounted_files(spark, base, max_bytes, id_width)
    return _guarded(lambda: spark.read, path, max_bytes, id_width, recursive)


def intake_stream(spark: SparkSession, path: str, max_bytes: int = R.MAX_UPLOAD_BYTES, id_width: int = R.ID_HEX_WIDTH) -> DataFrame:
    """``intake_files`` over a folder that files come into."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _guarded(lambda: spark.readStream.schema(schema), path, max_bytes, id_width, True)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNull())


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNotNull())
