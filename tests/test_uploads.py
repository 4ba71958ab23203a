"""Uploads that tasks list and hash: the driver asks the store for no files, whatever folders they lie in."""

import hashlib

from paperlens.operators import ingest
from paperlens.sources import listing, pdf


def test_files_are_listed_and_hashed_by_tasks(spark, tmp_path, monkeypatch):
    contents = {"a b.pdf": b"one", "x/50%+1.PDF": b"two" * 1_000_000, "x/y/c.pdf": b"", "世界.pdf": b"one"}
    for name, content in {**contents, "_hidden.pdf": b"x", ".tmp/d.pdf": b"x", "x/e.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(listing, "place", None)
    files = ingest.uploaded(spark, f"file://{tmp_path}")
    assert "binaryFile" not in files._jdf.queryExecution().toString()
    want = {(n.split("/")[-1], n.split("/")[-1][:-4], hashlib.sha256(c).hexdigest(), len(c)) for n, c in contents.items()}
    assert {tuple(r) for r in files.collect()} == want and files.count() == 4
    assert ingest.uploaded(spark, str(tmp_path / "nowhere")).count() == 0


def test_taken_by_name_and_content(spark):
    """A name that lies in two folders is taken with the content that is new, once."""
    files = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h2"), ("c", "h3"), ("c", "h3"), ("d", "h1")], "name string, file_hash string")
    known = spark.createDataFrame([("h1", "DONE"), ("h3", "FAILED")], "file_hash string, status string")
    assert sorted(map(tuple, ingest.taken(files, known).collect())) == [("a", "h2"), ("c", "h3")]
    forced = spark.createDataFrame([("d",), ("c",), ("e",)], "name string")
    assert sorted(map(tuple, ingest.taken(files, known, forced).collect())) == [("a", "h2"), ("c", "h3"), ("d", "h1")]


def test_files_are_not_taken_to_be_few(spark, tmp_path):
    """One row begins the listing; what comes of it is not planned to be broadcast by the driver before its size is known."""
    (tmp_path / "a.pdf").write_bytes(b"x")
    pages = pdf.read(spark, str(tmp_path), contents=False).groupBy("file").count()
    assert int(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 1 << 40
    plan = spark.range(10**9).selectExpr("CAST(id AS STRING) AS file").join(pages, "file")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
