"""Sinks (S07, S08, S11): a write touches only the documents it names."""
import os
import tempfile

from fixtures import F1_CONTRACT, F2_LABELS
from kitman.plans.release import DEMO_KEY, FIXED_ISSUED_AT, extract, release
from kitman.sources import sinks


def test_one_rewrite_keeps_five_thousand(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="kitman-sinks-"), "clean")
    docs = spark.range(5000).selectExpr("concat('doc_', id) as document_id", "concat('text ', id) as redacted_text")
    sinks.write_clean_text(docs, path)
    one = spark.createDataFrame([("doc_17", "changed")], "document_id string, redacted_text string")
    for _ in range(2):                                   # a replayed write replaces itself
        sinks.write_clean_text(one, path, name="again")
    got = {r.document_id: r.text for r in sinks.read_rows(spark, path).collect()}
    assert len(got) == 5000 and got["doc_17"] == "changed" and got["doc_18"] == "text 18"
    assert len(sinks._versions(spark, path)) == 2
    only = sinks.read_rows(spark, path, only=one)
    assert [r.text for r in only.collect()] == ["changed"]
    sinks.compact(spark, path, path + "-2")
    assert sinks.read_rows(spark, path + "-2").count() == 5000
    assert sinks.read_rows(spark, path + "-none", schema="document_id string").count() == 0


def test_clean_text_and_proofs(spark):
    docs = spark.createDataFrame([("doc_00000000aa", F1_CONTRACT), ("doc_00000000bb", F2_LABELS)],
                                 "document_id string, text string")
    rel = release(extract(docs), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    base = tempfile.mkdtemp(prefix="kitman-sinks-")
    sinks.write_proofs(rel, os.path.join(base, "proofs"))
    rows = sinks.read_rows(spark, os.path.join(base, "proofs"), "json").collect()
    assert len(rows) == 2 and all(r.proof.product == "kitman" for r in rows)
    stored = sinks.save_table(rel.select("document_id", "seal"), os.path.join(base, "state"))
    assert stored.count() == 2


def _texts(spark, path, **only):
    return {r.document_id: r.text for r in sinks.read_rows(spark, path, **only).collect()}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "document_id string, text string")


def _store():
    return os.path.join(tempfile.mkdtemp(prefix="kitman-sinks-"), "store")


def test_the_later_commit_wins_and_unfinished_writes_are_not_read(spark):
    path = _store()
    sinks.write_rows(_frame(spark, [("d1", "old"), ("d2", "old")]), path)
    first, second = (sinks.prepare(_frame(spark, [("d1", t)]), path) for t in ("prepared first", "prepared second"))
    sinks.prepare(_frame(spark, [("d1", "never committed")]), path)
    assert _texts(spark, path) == {"d1": "old", "d2": "old"}
    sinks.commit(spark, path, second)
    sinks.commit(spark, path, first)
    assert _texts(spark, path) == {"d1": "prepared first", "d2": "old"}


def test_a_number_is_taken_once(spark, monkeypatch):
    path = _store()
    assert sinks._create(spark, f"{path}/_log/000000000001", "[]") and not sinks._create(spark, f"{path}/_log/000000000001", "[]")
    made = [sinks.prepare(_frame(spark, [(f"d{i}", "x")]), path) for i in range(2)]
    newest, seen = sinks._newest, []

    def slow(spark_, path_):                                # another writer commits between listing and creating
        number = newest(spark_, path_)
        if not seen:
            seen.append(number)
            sinks.commit(spark, path, made[1], fold=False)
        return number
    monkeypatch.setattr(sinks, "_newest", slow)
    sinks.commit(spark, path, made[0], fold=False)
    assert seen == [1] and set(_texts(spark, path)) == {"d0", "d1"} and newest(spark, path) == 3


def test_documents_without_rows_and_erased_ones_are_gone(spark):
    path = _store()
    spans = lambda rows: spark.createDataFrame(rows, "document_id string, span_id string")
    ids = lambda *d: spark.createDataFrame([(x,) for x in d], "document_id string")
    sinks.save_table(spans([("d1", "a"), ("d1", "b"), ("d2", "c"), ("d3", "e"), (None, "n")]), path)
    got = sinks.save_table(spans([("d4", "f")]), path, documents=ids("d1", "d4"))
    assert sorted((r.document_id or "", r.span_id) for r in got.collect()) == [("", "n"), ("d2", "c"), ("d3", "e"), ("d4", "f")]
    assert sinks.read_rows(spark, path, only=ids("d1", "d2", "nowhere")).collect() == [("d2", "c")]
    sinks.erase(spark, path, ids("d2"))
    assert sinks.fold_versions(spark, path, every=True) == 1
    assert sorted(r.span_id for r in sinks.read_rows(spark, path).collect()) == ["e", "f", "n"]
    removed = sinks.clean(spark, path, older_than_s=0)
    assert len([r for r in removed if r.startswith("version=")]) == 3
    stored = spark.read.parquet(path)                       # the bytes of d1 and d2 are gone too
    assert sorted(r.span_id for r in stored.collect()) == ["e", "f", "n"]


def test_lookup_reads_only_the_files_of_the_ids(spark):
    path = _store()
    rows = spark.range(4000).selectExpr("concat('doc_', lpad(id, 6, '0')) as document_id", "concat('text ', id) as text")
    sinks.write_rows(rows.repartition(100), path)
    sinks.write_rows(_frame(spark, [("doc_000017", "new")]), path)
    only = _frame(spark, [("doc_000017", ""), ("doc_000400", ""), ("nowhere", "")])
    got = sinks.read_rows(spark, path, only=only)
    assert {r.document_id: r.text for r in got.collect()} == {"doc_000017": "new", "doc_000400": "text 400"}
    assert sum("/_ids/" not in f for f in sinks.read_rows(spark, path).inputFiles()) > 100 and len(got.inputFiles()) == 2
    assert sinks.read_rows(spark, path, only=_frame(spark, [("nowhere", "")])).count() == 0


def test_many_small_writes_leave_few_versions(spark):
    path = _store()
    for i in range(24):
        sinks.write_rows(_frame(spark, [(f"d{i % 7}", f"write {i}"), (f"only{i}", "x")]).coalesce(1), path, name=f"stream-{i}")
        sinks.write_rows(_frame(spark, [(f"d{i % 7}", "replayed")]), path, name=f"stream-{i}")
    assert len(sinks._versions(spark, path)) <= 2 * (sinks.FANOUT - 1)
    got = _texts(spark, path)
    assert len(got) == 31 and {got[f"d{i % 7}"] for i in range(17, 24)} == {f"write {i}" for i in range(17, 24)}
    sinks.write_rows(_frame(spark, [("d0", "replayed")]), path, name="stream-3")      # folded long ago
    assert _texts(spark, path) == got


def test_changed_documents_since_a_commit(spark):
    path = _store()
    sinks.write_rows(_frame(spark, [("d1", "a"), ("d2", "b")]), path)
    docs, number, whole = sinks.changed(spark, path)
    assert not whole and sorted(r[0] for r in docs.collect()) == ["d1", "d2"]
    for i in range(9):                                      # folds on the way
        sinks.write_rows(_frame(spark, [(f"e{i}", "x")]), path, documents=_frame(spark, [("d2", "")]) if i == 4 else None)
    docs, later, whole = sinks.changed(spark, path, number)
    assert not whole and sorted(r[0] for r in docs.collect()) == sorted(["d2", *(f"e{i}" for i in range(9))])
    docs, _, whole = sinks.changed(spark, path, later)
    assert not whole and docs.count() == 0
    sinks.clean(spark, path, older_than_s=0)                # too old to tell: all that is there
    docs, _, whole = sinks.changed(spark, path, number)
    assert whole and sorted(r[0] for r in docs.collect()) == sorted(["d1", *(f"e{i}" for i in range(9))])


def test_only_what_has_changed_is_released_again(spark):
    from kitman.operators.review import spans_table
    from kitman.plans.release import DECISION_SCHEMA, release_changes
    base = _store()
    texts = [("doc_00000000aa", F1_CONTRACT), ("doc_00000000bb", F2_LABELS), ("doc_00000000cc", "Email: c@example.com")]
    extracts = extract(spark.createDataFrame(texts, "document_id string, text string")).select("document_id", "text", "spans", "engine").persist()
    sinks.write_rows(extracts, f"{base}/extracts")
    made = lambda: release_changes(spark, f"{base}/extracts", f"{base}/decisions", f"{base}/releases", key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    now = lambda: {r.document_id: (r.redacted_count, r.seal) for r in sinks.read_rows(spark, f"{base}/releases").collect()}
    assert made() == 3 and made() == 0
    first = now()
    (span,) = spans_table(extracts.filter("document_id = 'doc_00000000cc'")).collect()
    decision = spark.createDataFrame([("doc_00000000cc", span.span_id, False, 1, 1)], DECISION_SCHEMA)
    sinks.write_rows(decision, f"{base}/decisions", name="my stream/1")
    assert made() == 1
    batch = {r.document_id: (r.redacted_count, r.seal) for r in release(extracts, decision, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).collect()}
    assert now() == batch and batch["doc_00000000cc"] != first["doc_00000000cc"] and batch["doc_00000000aa"] == first["doc_00000000aa"]
    sinks.erase(spark, f"{base}/extracts", decision)
    assert made() == 1 and set(now()) == {"doc_00000000aa", "doc_00000000bb"}


def test_text_files_share_folders(spark, tmp_path):
    """A file a document, but no folder a document; repeated and null ids keep a file each."""
    import os

    from kitman.sources import sinks
    rows = [(i, f"text {i}\r\nsecond line ü") for i in range(300)] + [(7, "again"), (None, "x"), (None, "")]
    sinks.write_text_files(spark.createDataFrame(rows, "doc long, value string"), str(tmp_path / "out"))
    files = {f: os.path.join(at, f) for at, _, names in os.walk(tmp_path / "out") for f in names}
    assert len(files) == 301 and set(files) == {f"doc={i}.txt" for i in [*range(300), "null"]}
    assert len({os.path.dirname(f) for f in files.values()}) <= 200
    read = lambda name: open(files[name], "rb").read().decode()
    assert read("doc=7.txt") == "again\ntext 7\r\nsecond line ü\n" and read("doc=null.txt") == "\nx\n" and read("doc=8.txt") == "text 8\r\nsecond line ü\n"


def test_text_files_of_a_partition_are_divided(spark, tmp_path, monkeypatch):
    import os

    from kitman.sources import sinks
    monkeypatch.setattr(sinks, "FOLDER_FILES", 10)
    rows = spark.range(95).selectExpr("id doc", "cast(id as string) value").coalesce(1)
    sinks.write_text_files(rows, str(tmp_path / "out"))
    sizes = [len(names) for _, _, names in os.walk(tmp_path / "out") if names]
    assert sum(sizes) == 95 and max(sizes) <= 10
