"""Records with quoted line breaks, across any file splits, against a character-by-character reader."""

import gzip
import os
import random
import tempfile

import pytest

from telespark.sources import logs, quoted


def brute(text, sep=";"):
    """Records of a file: a quote at the start of a field opens it; fields that never close open nothing."""
    lines = text.split("\n")
    out, k = [], 0
    while k < len(lines):
        inside, j = None, k
        state = False
        while j < len(lines):
            line, i, start = lines[j], 0, not state
            while i < len(line):
                c = line[i]
                if state:
                    if c == '"':
                        if line[i + 1 : i + 2] == '"':
                            i += 1
                        else:
                            state = False
                    start = False
                elif start and c == '"':
                    state, start = True, False
                else:
                    start = c == sep
                i += 1
            j += 1
            if not state:
                break
        if state:  # never closed: the rest are lines
            out += lines[k:]
            break
        out.append("\n".join(lines[k:j]))
        k = j
    return out


def cells(rng):
    return rng.choice(["", "a", "b c", '"q"', '"two\nlines"', '"x""y"', '"\n\n;\n"', '5" pipe', '"a"junk"b', 'x"', '""', '"""\n"""', "é"])


@pytest.mark.parametrize("seed", range(4))
def test_any_splits(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for f in range(25):
        text = "\n".join(";".join(cells(rng) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12)))
        if rng.random() < 0.2:
            text += '\nz;"never closed\nlast "one"; line'
        want[f"f{f}"] = brute(text)
        split = row = 0
        for line in text.split("\n"):
            if rng.random() < 0.3:
                split += 100
            row += 1
            rows.append((line, f"f{f}", split, row))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "value string, path string, split long, row long").repartition(5)
    got = {}
    for r in sorted(quoted.records(quoted.with_states(d, ";")).collect(), key=lambda r: (r.path, r.split, r.row)):
        got.setdefault(r.path, []).append(r.value)
    assert got == want


def test_files_without_open_fields_are_not_shuffled(spark):
    d = spark.createDataFrame([('a;"b";c', "f", 0, 1), ('x"y;"";', "f", 0, 2)], "value string, path string, split long, row long")
    out = quoted.records(quoted.with_states(d, ";"))
    assert out.count() == 2 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_lines(spark):
    text = '"' + 'a""' * 60_000 + '"'
    d = spark.createDataFrame([(text, "f", 0, 1), (text[:-1], "f", 0, 2), ('x";y', "f", 0, 3)], "value string, path string, split long, row long")
    assert quoted.records(quoted.with_states(d, ";")).count() == 2


@pytest.fixture(scope="module")
def tree():
    root = tempfile.mkdtemp(prefix="telespark-quoted-")

    def write(path, text):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)

    write(f"{root}/1/A/log_Event.csv", 'Timestamp;SessionID;"No\nte"\n2024-01-01 10:00:01;S1;"two\nlines"\n2024-01-01 10:00:02;S1;"say ""hi"";\n\nand go"\n2024-01-01 10:00:03;S1;plain\n')
    write(f"{root}/1/A/log_Meta.csv", "SessionID;Email\nS1;a@x\n")
    write(f"{root}/1/A/notes.txt", "not a log")
    with open(f"{root}/1/A/broken_Event.csv.gz", "wb") as f:
        f.write(b"this is no gzip file")
    with gzip.open(f"{root}/1/A/other.gz", "wt") as f:
        f.write("x")
    return root


def test_load_keeps_quoted_breaks(spark, tree):
    rows = {r.Timestamp: r for r in logs.load_logs(spark, tree, label="d").collect()}
    assert len(rows) == 3 and {r.Email for r in rows.values()} == {"a@x"}
    notes = [c for c in rows["2024-01-01 10:00:01"].asDict() if c.startswith("No")]
    assert notes == ["No\nte"]
    assert [rows[f"2024-01-01 10:00:0{k}"]["No\nte"] for k in (1, 2, 3)] == ["two\nlines", 'say "hi";\n\nand go', "plain"]


def test_small_splits_give_the_same_rows(spark, tree):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(str, logs.load_logs(spark, tree, label="d").drop("RowId").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        got = sorted(map(str, logs.load_logs(spark, tree, label="d").drop("RowId").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_other_files_are_not_opened(spark, tree):
    """The broken archive would fail the scan if it were read."""
    scanned = logs.scan(spark, tree, {"event": r"Event\.csv$", "meta": r"Meta\.csv$"})
    assert sorted(r.path.rsplit("/", 1)[1] for r in scanned.files.collect()) == ["log_Event.csv", "log_Meta.csv"]
    with pytest.raises(Exception):
        logs.scan(spark, tree, {"event": r"Event\.csv\.gz$"})
