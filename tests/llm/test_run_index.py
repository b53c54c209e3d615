"""Repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import docs

from tickframe.llm import run_index
from tickframe.llm.cluster import cut, together


def brute(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_matching_statistics():
    rng = random.Random(0)
    text = bytes(rng.choice(b"ab") for _ in range(300)) * 2 + bytes(rng.choice(b"abc") for _ in range(200)) + b"\xff"
    text = text[:40] + b"\xff" + text[:50] + b"\xff" + text
    got = run_index.RunIndex(np.frombuffer(text, np.uint8)).matching_statistics()

    def common(i, j):
        k = 0
        while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        return k

    for i in range(0, len(text), 3):
        assert got[i] == max(common(i, j) for j in range(len(text)) if j != i)


@pytest.mark.parametrize("crowd", [2000, 3])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(run_index, "CROWD", crowd)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh äö") for _ in range(n))
    passage, short, exact = noise(450), noise(199), noise(200)
    rows = [(i, noise(rng.randint(0, 900))) for i in range(30)]
    rows += [(100 + i, noise(rng.randint(0, 300)) + passage[rng.randint(0, 100) :] + noise(rng.randint(0, 300))) for i in range(25)]
    rows += [(200 + i, noise(50) + short + noise(50)) for i in range(5)]
    rows += [(300 + i, noise(50) + exact + noise(i)) for i in range(5)]
    rows += [(400, None), (401, ""), (402, "a" * 5000), (403, "xyz " * 300), (404, noise(700)), (405, "x" * 199), (405, "x" * 199), (406, exact), (None, exact)]
    rows += [(410, rows[3][1]), (411, rows[4][1]), (411, rows[4][1]), (412, passage + passage)]
    base = noise(3000)
    for i in range(8):
        k = rng.randrange(2900)
        rows.append((500 + i, base[:k] + "#" + base[k + 1 :]))
    out = run_index.remove_repeats(docs(spark, rows)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)
    assert run_index.remove_repeats(docs(spark, [])).count() == 0


def test_together_after_a_join(spark):
    """Rows of a key stay in one partition when the join before is changed at run time."""
    from pyspark.sql import functions as F

    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100MB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0"}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        rows = cut(spark.range(0, 4000, 1, 6).select((F.col("id") % 100).alias("k")))
        gone = cut(spark.range(0, 20, 1, 2).select((F.col("id") * 5).alias("k")))
        left = rows.join(gone, "k", "left_anti")

        def keys(batches):
            seen = {k for b in batches for k in b["k"].to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["k"])

        assert together(left, "k").mapInArrow(keys, "k long").groupBy("k").count().filter("count > 1").count() == 0
        assert left.repartition("k").mapInArrow(keys, "k long").groupBy("k").count().filter("count > 1").count() > 0  # why it is needed
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
