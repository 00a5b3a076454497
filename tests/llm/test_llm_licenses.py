import re

from llm_rows import docs
from pyspark.sql import functions as F

from telespark.llm import licenses


def test_spellings_of_known_texts(spark):
    mit = licenses.KNOWN["MIT"]
    changed = "  MIT LICENCE\nCopyright (c) 2019, 2020 Somebody <a@b.c>\n© 2021 Another\n\n" + mit.replace("\n", "\n * ").replace('"', "”").replace("sublicense", "sub license") + "\n"
    rows = [(1, mit), (2, mit.upper()), (3, changed), (4, mit + " more"), (5, None), (6, ""), (7, "Copyright 2020 me"), (8, "licensed under the apache license - version 2.0"),
            (9, licenses.KNOWN["ISC"].replace("FITNESS", "FITNESSE")), (1, mit), (None, "Released under the MIT Licence!"), (10, "x " * 100_000), (11, "all rights\treserved ©"), (12, "Copyrighted 2020 work\n" + mit)]
    got = sorted(((r.doc_id, r.license_id) for r in licenses.lookup(docs(spark, rows)).collect()), key=repr)
    want = [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT (with title)"), (4, None), (5, None), (6, None), (7, None), (8, "Apache-2.0 (short notice)"), (9, None),
            (None, "MIT (short notice)"), (10, None), (11, "LicenseRef-all-rights-reserved"), (12, None)]
    assert got == sorted(want, key=repr)


def test_each_known_text_is_found_under_any_copyright_lines(spark):
    """Other cases, wraps, marks and spellings, below copyright lines with and without a year."""
    heads = ["Copyright (c) The Authors\n", "© Somebody & Co.\n\n", "(c) Copyright 2001-2020 by A, B\n", "/* COPYRIGHT 1999 X */\n" + "Copyright (C) (c) © Y\n" * 12]
    rows, want = [], {}
    for k, (name, text) in enumerate(sorted(licenses.KNOWN.items())):
        words = re.sub(r"\blicense\b", "licence", text if k % 2 else text.upper()).split()
        for j, head in enumerate(heads):
            width = 5 + 3 * j + k % 4
            body = "\n".join(" * " + " ".join(words[i : i + width]) for i in range(0, len(words), width))
            rows.append((10 * k + j, head + body))
            want[10 * k + j] = name
    got = {r.doc_id: r.license_id for r in licenses.lookup(docs(spark, rows)).collect()}
    assert got == want


def test_own_table_of_texts(spark):
    known = spark.createDataFrame([("B", "Use it whilst you can."), ("A", "use it WHILE you can"), ("empty", " . "), (None, None)], "license_id string, text string")
    got = {r.doc_id: r.license_id for r in licenses.lookup(docs(spark, [(1, "Use it while you can"), (2, ""), (3, "use")]), known).collect()}
    assert got == {1: "A", 2: None, 3: None}


def test_canonical(spark):
    texts = ["Licence  LICENCE\nlicence", "a—b‘c’", "É é", "copyright owner; per cent", "Copyright (c) (c) 1999\nx\n  (C) 2001-2003 y\nz"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(F.col("t"))).collect()]
    assert got == ["license license license", "a b c", "É é", "copyright holder percent", "x z"]


def test_empty_table(spark):
    assert licenses.lookup(docs(spark, [])).collect() == []
