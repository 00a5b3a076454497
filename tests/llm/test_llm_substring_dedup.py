import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs, prose

from telespark.llm import substring_dedup as sd
from telespark.llm.hashing import sliding, sliding_min, word_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is None:
            continue
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            least = first.get(tuple(w[k : k + size]))
            if least is not None and (i is None or least < i):
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def sample(seed, size):
    rng = random.Random(seed)
    passages = [prose(rng, size + rng.randrange(3 * size)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 120):
        parts = [prose(rng, rng.randrange(2 * size)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    loop = " ".join(["ba", "na"] * size)  # repeats inside one text alone
    rows += [(2000, loop), (2001, "x " + loop), (2002, None), (2003, ""), (2004, " \n"), (2005, rows[0][1]), rows[1], (rows[2][0], rows[3][1]), (None, rows[4][1]), (None, "nobody " + prose(rng, 40))]
    return rows + [(2006, prose(rng, 20_000) + " " + passages[0])]


@pytest.mark.parametrize("seed,size", [(1, 5), (2, 50)])
def test_removed_words_are_those_of_all_windows(spark, seed, size):
    rows = sample(seed, size)
    got = sd.substring_duplicates(docs(spark, rows), size).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, size)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "MAX_CELLS", 1 << 12)
    rows = sample(3, 5)
    got = sd.substring_duplicates(docs(spark, rows), 5).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 5)


def test_empty_table(spark):
    assert sd.substring_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("share", [0.001, 0.6])
def test_packed_counters_add_up(share):
    rng, bits, k = np.random.default_rng(1), 14, 5
    width = 1 << (bits - 6)
    total, packed = np.zeros(width, int), []
    for _ in range(4):
        count = (rng.random(width) < share).astype(int) + (rng.random(width) < share)
        cells = np.flatnonzero(count)
        packed.append(sd._pack(cells + k * width, count[cells] > 1, k, bits))
        total += count
    out = np.zeros(width, np.uint8)
    for p in packed:
        sd._add(out, p)
    assert (out == np.minimum(total, 2)).all()


def test_words_and_sliding_hashes():
    texts = ["a b  c", "", None, "x", "y\tz\n", " lead Tr ail  ", "é ü", "a b c"]
    found = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.first[i], w.first[i + 1])] for w in word_chunks(pa.array(texts)) for i in range(len(w.first) - 1)]
    assert found == [WORD.findall(t or "") for t in texts]
    h = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)
    again = np.concatenate([h[:40], h[10:60]])
    assert (sliding(h, 7, 1)[10:34] == sliding(again, 7, 1)[40:64]).all() and len(set(sliding(h, 7, 1).tolist())) == 294
    assert (sliding_min(h, 26) == [h[i : i + 26].min() for i in range(275)]).all()
