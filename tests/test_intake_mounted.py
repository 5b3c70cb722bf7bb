"""S01 where the workers mount the file system: the rows of ``binaryFile``, without its one task for some 32 files."""
import os

import pytest
from pyspark.sql import functions as F

from kitman.sources import intake as I


def _put(folder, files):
    for name, data in files.items():
        at = os.path.join(folder, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(data)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = {"a.txt": b"one", "b/B.TXT": "عمر é".encode(), "b/c/bad.txt": b"x\xffy", "none.txt": b"", "b/edge.txt": b"a" * 40, "b/big.txt": b"a" * 41,
       "scan.pdf": b"%PDF", "b/run.exe": b"x", "noname": b"x", ".hidden.txt": b"x", "_too.txt": b"x", "_part=1.txt": b"x", "_dir/in.txt": b"x",
       "_day=1/in.txt": b"x", ".dir/in.txt": b"x", "_metadata_dir/in.txt": b"x", "_metadata.txt": b"x", "x.txt._COPYING_": b"x",
       "with space %20 + #.txt": b"x", "b/c/اسم.txt": b"x", "b/same.txt": b"same", "b/c/same.txt": b"same", "k=1/l.txt": b"l", "deep/1/2/3/4.txt": b"4"}


@pytest.mark.parametrize("names", [1, 3, 10_000])
def test_mounted_files_are_those_of_the_source(spark, tmp_path, monkeypatch, names):
    monkeypatch.setattr(I, "LIST_NAMES", names)                    # the fewer, the more rounds
    monkeypatch.setattr(I, "BATCH_BYTES", 50)
    _put(tmp_path / "in", ODD)
    os.symlink(tmp_path / "in" / "a.txt", tmp_path / "in" / "link.txt")
    os.symlink(tmp_path / "in" / "b" / "c", tmp_path / "in" / "linked")
    os.symlink(tmp_path / "nowhere", tmp_path / "in" / "nowhere.txt")
    want = _rows(I._guarded(lambda: spark.read, str(tmp_path / "in"), 40, 10, True))
    assert len(want) > 15 and {r[3] for r in want} == {None, "too_large", "pdf_text_required", "unsupported_type"}
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in/", f"{tmp_path}/x/../in"):
        assert I._mounted(spark, path) and _rows(I.intake_files(spark, path, 40)) == want


def test_other_paths_are_left_to_the_source(spark, tmp_path):
    _put(tmp_path, {"in/a.txt": b"a", "in/b.txt": b"b", "in/c/d.txt": b"d"})
    for path, n in ((f"{tmp_path}/in/a.txt", 1), (f"{tmp_path}/i*", 3)):
        assert I._mounted(spark, path) is None and I.intake_files(spark, path).count() == n
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.intake_files(spark, f"{tmp_path}/none")
    os.makedirs(tmp_path / "empty")
    assert I.intake_files(spark, f"{tmp_path}/empty").collect() == []


def test_many_small_files_are_few_tasks(spark, tmp_path):
    _put(tmp_path, {f"{i // 1000}/{i}.txt": b"text %d" % i for i in range(3000)})
    rows = I.intake_files(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism     # 2 x 94 by the source on 8 cores
    assert rows.filter("reject_reason IS NULL AND text = concat('text ', regexp_extract(path, '([0-9]+).txt$', 1))").count() == 3000


def test_tasks_grow_with_files_and_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "TASK_FILES", 10)
    files = spark.range(1000).select(F.col("id").cast("string").alias("path"), F.lit(1).cast("long").alias("length"))
    assert I._read(files, 40).rdd.getNumPartitions() == 100
    monkeypatch.setattr(I, "TASK_BYTES", 2)
    assert I._read(files, 40).rdd.getNumPartitions() == 500


def test_files_that_come_or_change_after_the_listing(spark, tmp_path):
    _put(tmp_path, {"a.txt": b"a", "b.txt": b"b", "c.txt": b"c"})
    rows = I.intake_files(spark, str(tmp_path), 40)
    _put(tmp_path, {"b.txt": b"b" * 41, "c.txt": b"", "late.txt": b"x"})
    assert {r.filename: (r.length, r.reject_reason, r.text) for r in rows.collect()} == {
        "a.txt": (1, None, "a"), "b.txt": (41, "too_large", None), "c.txt": (0, "empty", None)}
    os.remove(tmp_path / "a.txt")
    with pytest.raises(Exception, match="a.txt"):
        rows.collect()


def test_checksums_of_hadoop_are_checked(spark, tmp_path):
    spark.createDataFrame([("x" * 2000,)], "value string").coalesce(1).write.text(str(tmp_path / "out"))
    (part,) = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert os.path.exists(tmp_path / "out" / f".{part}.crc")
    (row,) = I.intake_files(spark, str(tmp_path / "out")).collect()
    assert row.text == "x" * 2000 + "\n"
    with open(tmp_path / "out" / part, "r+b") as f:
        f.seek(1500)
        f.write(b"y")
    with pytest.raises(Exception, match="checksum"):
        I.intake_files(spark, str(tmp_path / "out")).collect()
