"""Files listed and read by tasks: what is found is what Spark's readers find, and the driver holds no list of it."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from telespark.sources import files, logs


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my logs"
    for at in ("p1/a/x.csv", "p1/a/.hidden", "p1/a/_temporary", "p1/_a=1/x.csv", "p1/_gone/x.csv", "p1/.b/x.csv", "p2/b/x y%+#.csv", "p2/b/x.csv._COPYING_",
               "p2/b/c/d/e.csv", "p3/b[1]/x{2}.csv", "p3/b/empty.csv", "top.csv", "_top.csv", "_t=p.csv", "p4/a/ü.csv"):
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_bytes(b"" if "empty" in at else at.encode())
    os.symlink(root / "p1", root / "linked")
    os.symlink(root / "nowhere", root / "broken.csv")
    return str(root)


def _as_spark_lists(spark, root):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return sorted((r["path"], r["content"]) for r in found.withColumn("path", logs._path()).select("path", "content").collect())


@pytest.mark.parametrize("enough", [0, 1, 64])
@pytest.mark.parametrize("root", ["", "/", "/*", "/*/b", "/p[12]/*", "/p?/{a,b}/*.csv", "/top.csv", "/*.csv", "/p1/.b", r"/p3/b\[1\]", r"/p3/b\[1\]/*"])
def test_files_are_those_that_the_readers_find(spark, tree, monkeypatch, root, enough):
    monkeypatch.setattr(files, "FOLDERS_A_TASK", enough)
    listing = files.listed(spark, tree + root)
    found = {r["path"]: r["size"] for r in listing.collect() if r["size"]}
    want = _as_spark_lists(spark, tree + root)
    assert listing.where("size > 0").count() == len(want)
    assert sorted(found.items()) == [(p, len(c)) for p, c in want]
    assert sorted(map(tuple, files.contents(listing.where("size > 0")).collect())) == want


def test_what_is_missing_is_an_error_and_an_empty_folder_is_none(spark, tree, tmp_path):
    for root in ("/none", "/none/*", "/*/none", "/top.csv/*"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            logs._lines(spark, tree + root, F.lit(True))
    (tmp_path / "empty").mkdir()
    assert logs._lines(spark, str(tmp_path / "empty"), F.lit(True)).count() == 0


def test_the_driver_holds_no_list_of_the_log_files(spark, tree):
    lines = logs._lines(spark, tree, F.col("path").endswith(".csv"))
    assert lines.count() == 10
    assert not [f for f in lines.inputFiles() if f.endswith(".csv")]


def test_many_large_files_are_read_in_portions(spark, tree, monkeypatch):
    want = sorted(map(tuple, logs._lines(spark, tree, F.lit(True)).select("path", "value").collect()))
    monkeypatch.setattr(logs, "WHOLE_FILE", 9)
    monkeypatch.setattr(logs, "LARGE_FILES", 3)
    read = []
    monkeypatch.setattr(logs, "_below", lambda *a, below=logs._below: read.append(len(a[2])) or below(*a))
    got = logs._lines(spark, tree, F.lit(True))
    assert sorted(map(tuple, got.select("path", "value").collect())) == want
    assert len(read) > 1 and max(read) == 3


def test_other_file_systems_are_left_to_the_readers(spark, tree, monkeypatch):
    want = sorted(map(tuple, logs._lines(spark, tree, F.lit(True)).select("path", "split", "value").collect()))
    monkeypatch.setattr(files, "local_folder", lambda *a: None)
    assert files.listed(spark, tree) is None
    assert sorted(map(tuple, logs._lines(spark, tree, F.lit(True)).select("path", "split", "value").collect())) == want
