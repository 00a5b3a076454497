"""The written log tree: what is in its folders, and what the loader makes of it."""

import glob
import os

from telespark.sources import logs, logtree

COLUMNS = "Timestamp timestamp_ntz, Event string, SessionID string, Participant double, Condition string, Framecount double, RowId long"
ROWS = [(1.0, "A=b/c", "Game Started"), (1.0, "A=b/c", "Sample"), (2.0, "", "Mole Hit"), (2.0, None, "say x;y\nand z"), (None, "B", None), (None, "B", "Sample"), (3.0, "C", "")]


def _tree(spark, root):
    rows = [(None, ev, f"S{p}{c}", p, c, float(i), i) for i, (p, c, ev) in enumerate(ROWS)]
    return logtree.write_log_tree(spark.createDataFrame(rows, COLUMNS), root)


def test_one_file_for_each_session_and_kind_and_nothing_beside_it(spark, tmp_path):
    root = _tree(spark, str(tmp_path / "logs"))
    found = [os.path.relpath(p, root) for p in glob.glob(f"{root}/**/*", recursive=True, include_hidden=True) if os.path.isfile(p)]
    # A checksum file beside each would cost a process of its own, as would the file.
    assert all(os.path.basename(f) in ("log0.csv", "log1.csv") for f in found), found
    folders = {"Participant=1.0/Condition=A%3Db%2Fc", "Participant=2.0/Condition=__HIVE_DEFAULT_PARTITION__",
               "Participant=__HIVE_DEFAULT_PARTITION__/Condition=B", "Participant=3.0/Condition=C"}
    assert {os.path.dirname(os.path.dirname(f)) for f in found} == folders


def test_written_rows_are_read_back(spark, tmp_path):
    root = _tree(spark, str(tmp_path / "logs"))
    s = logs.scan(spark, root, {k: p + r"\.csv$" for k, p in logtree.KIND_PATTERNS.items()})
    got = logs.union_logs(s.table("event"), s.table("sample")).select("Event", "SessionID", "Framecount").collect()
    want = [(ev or None, f"S{p}{c}", str(float(i))) for i, (p, c, ev) in enumerate(ROWS)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert s.table("meta").count() == len({(p, c) for p, c, _ in ROWS})
