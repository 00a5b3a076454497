import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm_rows import docs, prose

from telespark.llm import sharding


def table(rng, singles, groups):
    rows = [(i, prose(rng, 5) + str(i)) for i in range(singles)]
    for k, n in enumerate(groups):
        rows += [(10_000 + 1000 * k + j, f"copy {k}") for j in range(n)]
    rng.shuffle(rows)
    return rows


def check(rows, got, shards=8):
    want = Counter((i, t or "") for i, t in rows)
    crc = {(i, zlib.crc32(t.encode())): t for i, t in want}
    assert Counter((r.doc_id, crc[r.doc_id, r.text_crc32]) for r in got) == want
    assert all(r.size == len(crc[r.doc_id, r.text_crc32].encode()) + 1 and r.law == "rows" and r.grown_shard is None for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in slots)
    spread = defaultdict(Counter)
    for r in got:
        spread[r.text_crc32][r.shard] += 1
    return spread


def cut(spread):
    """Links between equal texts in different shards."""
    return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in spread.values())


def test_groups_that_fit_stay_whole(spark):
    rows = table(random.Random(1), 300, [2] * 40 + [3] * 20 + [7, 12, 25])
    got = sharding.shard(docs(spark, rows).repartition(5)).collect()
    spread = check(rows, got)
    assert cut(spread) == 0


def test_a_group_larger_than_a_shard_takes_as_few_shards_as_it_can(spark):
    rows = table(random.Random(2), 200, [250, 2, 2, 3, 40])
    spread = check(rows, sharding.shard(docs(spark, rows).repartition(7)).collect())
    big = spread[zlib.crc32(b"copy 0")]
    assert len(big) <= 5  # 497 rows: 62 or 63 a shard, so four and a bit
    assert sum(len(c) > 1 for c in spread.values()) <= 2


def test_all_rows_linked(spark):
    rows = table(random.Random(3), 0, [2] * 120)
    start = sharding.shard(docs(spark, rows).repartition(4), rounds=0).collect()
    end = sharding.shard(docs(spark, rows).repartition(4)).collect()
    before, after = cut(check(rows, start)), cut(check(rows, end))
    assert before > 100 and after <= 8


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "x"), (None, None), (3, "é" * 50_000), (3, "é" * 50_000), (4, "x"), (4, "x")]
    spread = check(rows, sharding.shard(docs(spark, rows)).collect())
    assert len(spread) == 3


def test_other_links_and_fewer_shards(spark):
    rows = table(random.Random(5), 30, [4, 4])
    df = docs(spark, rows).selectExpr("*", "cast(doc_id % 10 as string) AS host")
    got = sharding.shard(df, shards=3, group=df["host"]).collect()
    check(rows, got, 3)


@pytest.mark.parametrize("n", [0, 1, 7, 9])
def test_few_rows(spark, n):
    rows = [(i, "same") for i in range(n)]
    check(rows, sharding.shard(docs(spark, rows)).collect())
