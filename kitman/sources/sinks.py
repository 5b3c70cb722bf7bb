"""Sinks and stores (S07–S11): tables keyed by ``document_id``.

A write adds a folder ``version=<name>-<own id>`` with just the rows handed in,
and is not there for readers until it is committed: ``_log/<number>`` is created
by the first writer to do so, and holds the list of all live versions in order.
A writer that finds the number taken adds itself to the newer list and takes
the next one, so of two concurrent writes the one committed last is the newer.

A version says apart from its rows which documents it names (``_ids``, sorted
by id, with the file that holds them): a document named without rows has none
any more.  Readers take each document's rows from the newest version that names
it.  Few documents are looked up in the ids first, and only their files are read.

Versions are folded in levels of ``FANOUT`` as they are added, so their number
grows with the logarithm of the writes; folding commits like any other writer,
readers go on with the list they have, and ``clean`` removes what no list names.
"""
from __future__ import annotations

import json
import os
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ids up to which a set of wanted or superseded documents is broadcast (counted before).
BROADCAST_IDS = 500_000
#: Wanted ids up to which files are chosen before the read (the ids come to the driver).
LOOKUP_IDS = 10_000
#: Versions of a level that are folded into one of the next.
FANOUT = 8
#: Ids of a file of ``_ids``.
ID_FILE = 2_000_000


@dataclass
class Version:
    """A write.  ``ids``: least and greatest id of each file of its ``_ids``, or
    None if its rows have no ``document_id``.  ``names``: the named writes in it,
    with the highest number of each.  ``note``: what its writer wants to find again."""

    folder: str
    names: dict[str, int]
    schema: str
    documents: int = 0
    level: int = 0
    ids: list[tuple[str, str, str]] | None = None
    note: dict = field(default_factory=dict)


# -- files ------------------------------------------------------------------------

def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is there; listing errors are raised, not taken for absence."""
    fs, p = _folder(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.getFileStatus(p).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.mkdirs(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _folder(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """The file with this text, unless the path is taken: then False."""
    fs, p = _folder(spark, path)
    fs.mkdirs(p.getParent())
    tmp = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(text.encode())
    out.close()
    try:
        if fs.getScheme() == "file":                        # a local rename would replace; a link does not
            local = lambda x: spark._jvm.java.io.File(x.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(local(p), local(tmp))
            return True
        if fs.exists(p):
            return False
        return bool(fs.rename(tmp, p))
    except Exception as e:  # noqa: BLE001  the gateway wraps what Java raises
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(tmp, False)


#: Text files of a folder.
FOLDER_FILES = 1000


def write_text_files(rows: DataFrame, path: str) -> None:
    """A file ``doc=<doc>.txt`` for each ``doc`` of rows (doc, value), its values by
    order with a line feed after each; null ids share a file.

    On a file system that the workers mount, each task writes its own files, a
    thousand a folder: Spark's writer makes a folder a file, and Hadoop's local file
    system starts a process for each file's mode and another for its checksum's.
    Elsewhere Spark's writer is used, with folders ``doc=<doc>``."""
    spark = rows.sparkSession
    fs, p = _folder(spark, path)
    if fs.getScheme() != "file":
        rows.repartition("doc").write.partitionBy("doc").text(path)
        return
    base, per_folder = p.toUri().getPath(), FOLDER_FILES
    fs.mkdirs(p)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True))
        for doc, same in groupby(pairs, key=itemgetter(0)):
            folder = f"{base}/{part:05d}-{n // per_folder:05d}"
            if n % per_folder == 0:
                os.makedirs(folder, exist_ok=True)
            tmp = f"{folder}/.{uuid.uuid4().hex}"           # a task tried twice leaves whole files only
            with open(tmp, "wb", buffering=0) as out:       # mostly one value a file, so one write
                for _, value in same:
                    line = memoryview(value + b"\n")
                    while line:
                        line = line[out.write(line):]
            os.rename(tmp, f"{folder}/doc={'null' if doc is None else doc}.txt")
            n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    rows.repartition("doc").sortWithinPartitions("doc", "value").mapInArrow(write, "n long").agg(F.sum("n")).first()


# -- the list of versions -----------------------------------------------------------

def _newest(spark: SparkSession, path: str) -> int:
    return max((int(n) for n in _names(spark, f"{path}/_log") if n.isdigit()), default=0)


def _live(spark: SparkSession, path: str, number: int | None = None) -> list[Version]:
    """The committed versions, oldest first."""
    number = _newest(spark, path) if number is None else number
    return [Version(**v) for v in json.loads(_read_text(spark, f"{path}/_log/{number:012d}"))] if number else []


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [v.folder for v in _live(spark, path)]


def _commit(spark: SparkSession, path: str, change) -> list[Version] | None:
    """Commits what ``change`` makes of the newest list, however many others commit
    meanwhile; ``change`` may return None to give up."""
    while True:
        number = _newest(spark, path)
        made = change(_live(spark, path, number))
        if made is None or _create(spark, f"{path}/_log/{number + 1:012d}", json.dumps([asdict(v) for v in made])):
            return made


def _numbered(name: str) -> tuple[str, int]:
    """``stream-17`` is the 17th write of ``stream``."""
    m = re.fullmatch(r"(.*)-(\d+)", name)
    return (m[1], int(m[2])) if m else (name, 0)


# -- writing ------------------------------------------------------------------------

def prepare(df: DataFrame, path: str, fmt: str = "parquet", name: str | None = None,
            documents: DataFrame | None = None, level: int = 0, note: dict | None = None) -> Version:
    """Writes the rows and their ids; nothing reads them before ``commit``.
    ``documents``: further documents that the write names, with rows or not."""
    spark = df.sparkSession
    base, number = _numbered(name) if name else (uuid.uuid4().hex, 0)
    folder = re.sub(r"[^\w.-]", "_", f"{name or base}-{uuid.uuid4().hex}", flags=re.ASCII)
    df.write.format(fmt).save(f"{path}/version={folder}")
    made = Version(folder, {base: number} if name else {}, df.schema.json(), level=level, note=note or {})
    if "document_id" in df.columns:
        rows = spark.read.format(fmt).schema(df.schema).load(f"{path}/version={folder}")
        ids = rows.select("document_id", F.col("_metadata.file_name").alias("file")).distinct()
        if documents is not None:
            named = documents.select("document_id", F.lit(None).cast("string").alias("file")).distinct()
            ids = ids.unionByName(named.join(ids, "document_id", "left_anti"))
        _write_ids(ids, f"{path}/_ids/{folder}")
        index = spark.read.schema("document_id string, file string").parquet(f"{path}/_ids/{folder}")
        bounds = index.groupBy(F.col("_metadata.file_name").alias("f")).agg(
            F.min("document_id").alias("low"), F.max("document_id").alias("high"), F.count_distinct("document_id").alias("n")).collect()
        made.ids = sorted((b["f"], b["low"], b["high"]) for b in bounds if b["low"] is not None)
        made.documents = sum(b["n"] for b in bounds)
    return made


def _write_ids(ids: DataFrame, path: str) -> None:
    ids = ids.persist()
    try:
        parts = -(-ids.count() // ID_FILE) or 1
        ids.repartitionByRange(parts, "document_id").sortWithinPartitions("document_id").write.parquet(path)
    finally:
        ids.unpersist()


def _there(live: list[Version], names: dict[str, int]) -> bool:
    """Is a write of one of these names committed already, alone or folded?"""
    return any(v.names.get(base, -1) >= number if v.level else v.names.get(base) == number
               for v in live for base, number in names.items())


def commit(spark: SparkSession, path: str, made: Version, fmt: str = "parquet", fold: bool = True) -> str:
    """Makes a prepared write the newest version, unless one of its name is there."""
    if _commit(spark, path, lambda live: None if _there(live, made.names) else [*live, made]) and fold:
        fold_versions(spark, path, fmt)
    return made.folder


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", name: str | None = None,
               documents: DataFrame | None = None, note: dict | None = None) -> str:
    """Add the rows as a new version.  A ``name`` (its last number counting up) is
    written once: a repeated write, a replayed micro-batch, changes nothing.
    ``documents``: documents that the write names besides those of its rows; what
    older versions hold of them is gone."""
    spark = df.sparkSession
    if name and _there(_live(spark, path), dict([_numbered(name)])):
        return name
    return commit(spark, path, prepare(df, path, fmt, name, documents, note=note), fmt)


def erase(spark: SparkSession, path: str, documents: DataFrame, fmt: str = "parquet") -> str:
    """The documents (document_id) have no rows any more.  Their bytes go when
    ``fold_versions`` has folded and ``clean`` removed the versions that held them."""
    live = _live(spark, path)
    none = spark.createDataFrame([], StructType.fromJson(json.loads(live[-1].schema)))
    return write_rows(none, path, fmt, documents=documents)


# -- reading ------------------------------------------------------------------------

def _load(spark: SparkSession, path: str, fmt: str, live: list[Version], files: list[str] | None = None) -> DataFrame:
    """Rows of the versions (or of just these files of them), with ``version``."""
    schema = StructType.fromJson(json.loads(live[-1].schema)).add("version", "string")
    at = files if files is not None else [f"{path}/version={v.folder}" for v in live]
    return spark.read.format(fmt).schema(schema).option("basePath", path).load(at)


def _ids(spark: SparkSession, path: str, live: list[Version], files: list[str] | None = None) -> DataFrame:
    """(document_id, file, folder, place) of the versions; place: the version's number in order."""
    at = files if files is not None else [f"{path}/_ids/{v.folder}" for v in live]
    rows = spark.read.schema("document_id string, file string").parquet(*at)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    order = F.create_map(*(F.lit(x) for i, v in enumerate(live) for x in (v.folder, i)))
    return rows.select("document_id", "file", folder.alias("folder")).withColumn("place", order[F.col("folder")])


def _looked_up(spark: SparkSession, path: str, fmt: str, live: list[Version], wanted: list[str]) -> DataFrame:
    """Rows of few documents: the ids' files by their ranges, then the rows' files by the ids."""
    def meets(low: str, high: str) -> bool:
        i = bisect_left(wanted, low)
        return i < len(wanted) and wanted[i] <= high

    wanted = sorted(wanted)
    files = [f"{path}/_ids/{v.folder}/{f}" for v in live for f, low, high in v.ids or [] if meets(low, high)]
    newest: list = []
    if files:
        # a join, not a list of literals: every rule of the planner would walk through it
        few = F.broadcast(spark.createDataFrame([(d,) for d in wanted], "document_id string"))
        within = F.col("document_id").between(wanted[0], wanted[-1])
        newest = (_ids(spark, path, live, files).where(within).join(few, "document_id", "left_semi").groupBy("document_id")
                  .agg(F.max("place").alias("place"), F.collect_list(F.struct("place", "folder", "file")).alias("at"))
                  .select("document_id", F.explode(F.filter("at", lambda a: a["place"] == F.col("place"))).alias("a"))
                  .where("a.file is not null").select("document_id", "a.folder", "a.file").collect())
    if not newest:
        return _load(spark, path, fmt, live).where("false").drop("version")
    rows = _load(spark, path, fmt, live, sorted({f"{path}/version={r['folder']}/{r['file']}" for r in newest}))
    current = spark.createDataFrame(sorted({(r["document_id"], r["folder"]) for r in newest}), "document_id string, version string")
    return (rows.where(F.col("document_id").between(wanted[0], wanted[-1]))
            .join(F.broadcast(current), ["document_id", "version"], "left_semi").drop("version"))


def read_rows(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None,
              only: DataFrame | None = None) -> DataFrame:
    """The current rows of every document, or of the documents in ``only``
    (document_id).  Up to ``LOOKUP_IDS`` of them are looked up and only their files
    read; more filter the scan before anything is shuffled.  Rows of versions
    without a ``document_id`` are all current.  ``schema``: of an empty result if
    nothing was ever written."""
    live = _live(spark, path)
    if not live:
        if schema is None:
            raise FileNotFoundError(f"{path}: no committed version")
        return spark.createDataFrame([], schema)
    ids = None if only is None else only.select("document_id").where("document_id is not null").distinct()
    if ids is not None:
        wanted = [r[0] for r in ids.limit(LOOKUP_IDS + 1).collect()]
        if len(wanted) <= LOOKUP_IDS:
            return _looked_up(spark, path, fmt, live, wanted)
    return _rows(spark, path, fmt, live, ids)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _rows(spark: SparkSession, path: str, fmt: str, live: list[Version], ids: DataFrame | None = None) -> DataFrame:
    rows = _load(spark, path, fmt, live)
    if ids is not None:
        rows = rows.join(_few(ids), "document_id", "left_semi")
    keyed = [v for v in live if v.ids is not None]
    if len(keyed) > 1:
        # only what a newer version names too leaves the scan; the rows are not shuffled for it
        named = _ids(spark, path, keyed).select("document_id", "folder", "place").distinct()
        newest = named.groupBy("document_id").agg(F.max("place").alias("newest"), F.count("*").alias("n")).where("n > 1")
        old = (named.join(newest, "document_id").where("place < newest")
               .select("document_id", F.col("folder").alias("version")))
        rows = rows.join(_few(old), ["document_id", "version"], "left_anti")
    return rows.drop("version")


# -- what has changed ---------------------------------------------------------------

def changed(spark: SparkSession, path: str, since: int = 0) -> tuple[DataFrame, int, bool]:
    """(document_id) of the documents named by the writes committed after list number
    ``since``, the newest number, and whether that is all there is to tell: if lists
    after ``since`` have been cleaned away, all documents of the store count as
    changed, and which ones were erased is not known.  Folding changes nothing."""
    number = _newest(spark, path)
    have = {int(n) for n in _names(spark, f"{path}/_log") if n.isdigit()} | {0}       # before the first commit there was nothing
    whole = not have.issuperset(range(since, number + 1))
    if not whole:
        lists = [_live(spark, path, n) for n in range(since, number + 1)]
        folders = {v.folder for old, new in zip(lists, lists[1:]) for v in new if not v.level and v.folder not in {x.folder for x in old}}
        whole = not all(exists(spark, f"{path}/_ids/{f}") for f in folders)
    if whole:
        folders = set(_versions(spark, path))
    at = [f"{path}/_ids/{f}" for f in sorted(folders)]
    none = spark.createDataFrame([], "document_id string")
    return (spark.read.schema("document_id string").parquet(*at).distinct() if at else none), number, whole


def noted(spark: SparkSession, path: str) -> dict:
    """The notes of all versions, newer ones over older ones."""
    out: dict = {}
    for v in _live(spark, path):
        out |= v.note
    return out


# -- upkeep ---------------------------------------------------------------------------

def _run_to_fold(live: list[Version]) -> list[Version]:
    """The newest versions of a level and below, if they are ``FANOUT`` or more."""
    for level in sorted({v.level for v in live}):
        run = []
        for v in reversed(live):
            if v.level > level:
                break
            run.append(v)
        if len(run) >= FANOUT:
            return run[::-1]
    return []


def fold_versions(spark: SparkSession, path: str, fmt: str = "parquet", every: bool = False) -> int:
    """Folds runs of small versions into one, which takes their place; ``every``: all
    versions.  Returns how many are left.  Names without rows are kept as long
    as an older version may hold rows of theirs."""
    while True:
        live = _live(spark, path)
        run = live if every and len(live) > 1 else _run_to_fold(live)
        if not run:
            return len(live)
        keyed = all(v.ids is not None for v in run)
        named = _ids(spark, path, run).select("document_id").distinct() if keyed and run[0] is not live[0] else None
        merged = prepare(_rows(spark, path, fmt, run), path, fmt, documents=named, level=max(v.level for v in run) + 1)
        for v in run:
            merged.names |= {b: max(n, merged.names.get(b, -1)) for b, n in v.names.items()}
            merged.note |= v.note

        def replaced(now: list[Version]) -> list[Version] | None:
            at = [v.folder for v in now]
            if run[0].folder not in at:
                return None
            i = at.index(run[0].folder)
            if at[i:i + len(run)] != [v.folder for v in run]:
                return None                                 # another writer replaced one: leave it to the next time
            return [*now[:i], merged, *now[i + len(run):]]

        if _commit(spark, path, replaced) is None or every:
            return len(_live(spark, path))


def clean(spark: SparkSession, path: str, older_than_s: float = 86_400.0) -> list[str]:
    """Removes versions that the newest list does not name (folded, erased or never
    committed) and older lists, if they were last changed ``older_than_s`` seconds
    ago: longer than any reader or writer takes.  Returns what it removed."""
    fs, _ = _folder(spark, path)
    number = _newest(spark, path)
    keep = set(_versions(spark, path))
    before = spark._jvm.java.lang.System.currentTimeMillis() - older_than_s * 1000
    gone = [f"version={n}" for n in (x.removeprefix("version=") for x in _names(spark, path) if x.startswith("version=")) if n not in keep]
    gone += [f"_ids/{n}" for n in _names(spark, f"{path}/_ids") if n not in keep]
    gone += [f"_log/{n}" for n in _names(spark, f"{path}/_log") if n.isdigit() and int(n) < number]
    gone = [g for g in gone if fs.getFileStatus(_folder(spark, f"{path}/{g}")[1]).getModificationTime() <= before]
    for g in gone:
        fs.delete(_folder(spark, f"{path}/{g}")[1], True)
    return gone


def compact(spark: SparkSession, path: str, to: str, fmt: str = "parquet") -> None:
    """Current rows of ``path`` as the first version of a new table ``to``."""
    write_rows(read_rows(spark, path, fmt), to, fmt)


# -- the sinks -------------------------------------------------------------------------

def write_clean_text(releases: DataFrame, path: str, name: str | None = None) -> None:
    """Redacted text per document."""
    write_rows(releases.select("document_id", F.col("redacted_text").alias("text")), path, name=name)


def write_proofs(proofs: DataFrame, path: str, name: str | None = None) -> None:
    """Proofs as JSON lines (non-ASCII kept as is)."""
    write_rows(proofs.select("document_id", "proof", "body_json", "seal", "key_id"), path, "json", name)


def clean_copy(requests: DataFrame, signed: DataFrame, redacted: DataFrame) -> DataFrame:
    """Signed copy if present, else redacted text, else not found."""
    s = signed.select("document_id", F.col("uri").alias("signed_uri"))
    r = redacted.select("document_id", F.col("text").alias("redacted_text"))
    out = requests.select("document_id").join(s, "document_id", "left").join(r, "document_id", "left")
    return out.withColumn(
        "source", F.when(F.col("signed_uri").isNotNull(), "signed")
        .when(F.col("redacted_text").isNotNull(), "redacted").otherwise("not_found"))


def proof_lookup(requests: DataFrame, proofs: DataFrame) -> DataFrame:
    """Proofs for the requested ids (semi join)."""
    return proofs.join(requests.select("document_id"), "document_id", "left_semi")


def stored_proofs(requests: DataFrame, path: str) -> DataFrame:
    """S10 from the proof sink: only the files that hold a requested id are read, if
    there are at most ``LOOKUP_IDS`` of them."""
    return read_rows(requests.sparkSession, path, "json", only=requests)


def save_table(df: DataFrame, path: str, name: str | None = None, documents: DataFrame | None = None) -> DataFrame:
    """S11 state store: write and read back (cuts lineage in the shared place).
    ``documents``: the documents whose state this is; those without rows have none."""
    write_rows(df, path, name=name, documents=documents)
    return read_rows(df.sparkSession, path)


def save_extracts_bucketed(extracts: DataFrame, table: str, n_buckets: int) -> DataFrame:
    """Store extracts (text + span arrays) bucketed and sorted by
    ``document_id``.  A later release joins decisions to this table with an
    exchange on the decision side only: the big text side is already
    partitioned by the join key."""
    (extracts.write.mode("overwrite").format("parquet")
     .bucketBy(n_buckets, "document_id").sortBy("document_id").saveAsTable(table))
    return extracts.sparkSession.table(table)
