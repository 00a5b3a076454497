"""CSV log loader on a temporary tree with the awkward cases."""

import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from telespark.operators.clean import clean
from telespark.sources import logs


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def tree():
    root = tempfile.mkdtemp(prefix="telespark-logs-")
    # participant 1, condition CondA: two event files with different headers
    _write(f"{root}/1/CondA/log_1_Event.csv",
           "Timestamp;Event;SessionID;MoleId\n"
           "2024-01-01 10:00:01.5;Game Started;S1;NULL\n"
           "2024-01-01 10:00:02;Mole Hit;S1;0102\n")
    _write(f"{root}/1/CondA/log_2_Event.csv",
           "MoleId;Event;Timestamp;SessionID;MolePositionWorldX\n"
           "0203;Mole Spawned;2024-01-01 10:00:03.25;S1;abc\n"
           ";Game Finished;2024-01-01 10:00:09;S1;1.5\n")
    _write(f"{root}/1/CondA/log_3_Sample.csv",
           "Timestamp;Event;SessionID;RightControllerLaserPosWorldX\n"
           "2024-01-01 10:00:01.75;Sample;S1;0.25\n"
           "not a time;Sample;S1;0.5\n"
           "2024-01-01 10:00:04;Sample;NULL;1\n")
    _write(f"{root}/1/CondA/log_4_Sample.csv", "")            # empty file
    _write(f"{root}/1/CondA/log_1_Meta.csv",
           "Timestamp;Email;Framecount;SessionID\n2024-01-01 10:00:00;a@x;1;S1\n")
    _write(f"{root}/2/CondB/log_1_Meta.csv",
           "Timestamp;Email;Framecount;SessionID\n2024-01-01 11:00:00;b@x;1;NULL\n")
    _write(f"{root}/2/CondB/log_1_Event.csv",
           "Timestamp;Event;SessionID\n2024-01-01 11:00:01;Game Started;NULL\n")
    return root


def test_load_by_session_id(spark, tree):
    raw = logs.load_logs(spark, tree, label="testdata3/")
    d = clean(raw)
    rows = d.collect()
    assert len(rows) == 8                       # 4 + 3 sample rows (+0 empty) + 1
    by = {(r.Event, str(r.Timestamp)): r for r in rows}
    hit = by[("Mole Hit", "2024-01-01 10:00:02")]
    assert hit.Participant == 1.0 and hit.Condition == "CondA" and hit.MetaEmail == "a@x"
    spawn = [r for r in rows if r.Event == "Mole Spawned"][0]
    assert spawn.MolePositionWorldX is None and spawn.MoleId == "0203"
    fin = [r for r in rows if r.Event == "Game Finished"][0]
    assert fin.MoleId is None and fin.MolePositionWorldX == 1.5
    bad = [r for r in rows if r.Event == "Sample" and r.Timestamp is None]
    assert len(bad) == 1 and bad[0].RightControllerLaserPosWorldX == 0.5
    # missing SessionID on both sides matches (as dplyr joins do)
    p2 = [r for r in rows if r.SessionID is None]
    assert {r.MetaEmail for r in p2} == {"b@x"}
    assert len(p2) == 2


def test_load_without_meta_uses_paths(spark, tree):
    d = clean(logs.load_logs(spark, tree, meta=None, label="testdata3/"))
    got = {(r.Participant, r.Condition) for r in d.collect()}
    assert got == {(1.0, "CondA"), (2.0, "CondB")}


def test_row_id_is_load_order(spark, tree):
    d = logs.load_logs(spark, tree, meta=None, label="testdata3/")
    order = [r.Event for r in d.orderBy("RowId").collect()]
    assert order[:4] == ["Game Started", "Mole Hit", "Mole Spawned", "Game Finished"]
    assert order[-3:] == ["Sample", "Sample", "Sample"]


def test_path_split(spark):
    df = spark.createDataFrame([("testdata3//1/CondA/log_1_Event.csv",)], "filename string")
    r = logs.path_split(df).first()
    assert (r.i0, r.i1, r.i2, r.i3, r.i4) == ("testdata3", "", "1", "CondA", "log_1_Event.csv")
    assert (r.i5, r.i6, r.i7, r.i8, r.i9) == ("testdata3//1/CondA/log", "1", "Event.csv", None, None)


def test_meta_rename_all_or_nothing(spark):
    full = spark.createDataFrame([("t", "e", "1", "S")], "Timestamp string, Email string, Framecount string, SessionID string")
    assert "MetaEmail" in logs.meta_rename(full).columns
    part = spark.createDataFrame([("t", "S")], "Timestamp string, SessionID string")
    assert logs.meta_rename(part).columns == ["Timestamp", "SessionID"]


def test_load_triplet(spark, tree):
    d = logs.load_triplet(spark, f"{tree}/1/CondA/log_1_Meta.csv", f"{tree}/1/CondA/log_1_Event.csv",
                          f"{tree}/1/CondA/log_3_Sample.csv")
    rows = d.collect()
    assert len(rows) == 5                         # 2 events + 3 samples
    assert {r.MetaEmail for r in rows if r.SessionID == "S1"} == {"a@x"}
    assert [r.MetaEmail for r in rows if r.SessionID is None] == [None]


def test_folder_names_are_taken_as_they_are(spark):
    root = tempfile.mkdtemp(prefix="telespark-logs-") + "/my logs"
    body = "Timestamp;Event;SessionID\n2024-01-01 10:00:01;Game Started;S1\n"
    _write(f"{root}/0/Test Condition 2/log_1_Event.csv", body)
    _write(f"{root}/0/dose=5/log_1_Event.csv", body)
    _write(f"{root}/0/50% + #1/log_1_Event.csv", body)
    got = {r.Condition for r in clean(logs.load_logs(spark, root, meta=None, label="testdata3/")).collect()}
    assert got == {"Test Condition 2", "dose=5", "50% + #1"}


def test_odd_headers(spark):
    root = tempfile.mkdtemp(prefix="telespark-logs-")
    _write(f"{root}/a/1_Event.csv", "\ufeffEvent;;SessionID;Event;a.b `c`\nx;skip;S1;again;1\n\n   \ny;;S1\n\"q;1\";2;S2;3;4;5\n")
    _write(f"{root}/a/2_Event.csv", "SessionID;Event\n")
    rows = logs.load_logs(spark, root, meta=None).collect()
    got = sorted((r.Event, r.SessionID, r["a.b `c`"]) for r in rows if r.Event)
    assert got == [("q;1", "S2", "4"), ("x", "S1", "1"), ("y", "S1", None)]


def test_nan_is_missing(spark):
    raw = spark.createDataFrame([("2024-01-01 10:00:00", "Mole Spawned", "NaN", "NaN"), ("2024-01-01 10:00:01", "Mole Spawned", "Inf", "1")],
                                "Timestamp string, Event string, MolePositionWorldX string, Participant string")
    got = clean(raw).select("MolePositionWorldX", "Participant").collect()
    assert got[0].MolePositionWorldX is None and got[0].Participant is None and got[1].MolePositionWorldX == float("inf")


def test_small_files_are_read_whole_and_cut_as_the_text_reader_cuts(spark, tmp_path, monkeypatch):
    bodies = [b"x\ny\n", b"\xef\xbb\xbfx\r\ny", b"", b"\n\n", b"x\r\ry\n\r", b"x\n\n", b"\r\n", b"q\x0bz\xc2\x85w", b"\xef\xbb\xbf", b"x\n\xef\xbb\xbfz\n"]
    for i, body in enumerate(bodies):
        (tmp_path / f"f {i}%+.csv").write_bytes(body)
    with gzip.open(tmp_path / "packed.csv.gz", "wb") as f:
        f.write(b"k\nl\n")
    (tmp_path / "large.csv").write_bytes(b"of many lines\n" * 40)
    monkeypatch.setattr(logs, "WHOLE_FILE", 100)
    confs = dict(spark.sparkContext.getConf().getAll()), spark.conf.get(logs._LISTING_TASKS)
    got = logs._lines(spark, str(tmp_path), F.lit(True))
    plain = spark.read.text(str(tmp_path)).select("value", logs._path().alias("path"), F.monotonically_increasing_id().alias("row"))

    def by_file(d):
        out = {}
        for r in d.orderBy("path", "row").collect():
            out.setdefault(r["path"], []).append(r["value"])
        return out

    assert by_file(got) == by_file(plain)
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get(logs._LISTING_TASKS)) == confs


def test_many_folders_and_small_files_are_few_tasks(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"p{i}").mkdir()
        (tmp_path / f"p{i}" / "Event.csv").write_text("a;b\n1;2\n")
    spark.sparkContext.setJobGroup("many folders", "")
    found = logs.scan(spark, str(tmp_path), {"event": r"Event\.csv$"})
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("many folders") for s in tracker.getJobInfo(j).stageIds]
    tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    assert max(tasks) <= logs.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert found.table("event").count() == 120
