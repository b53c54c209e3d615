"""Exact dedup, mixing and decontamination against plain Python on small tables."""

import hashlib
import random
import re
from collections import defaultdict

from common import docs, hits, reshared

from tickframe.llm import exact_dedup, mixing, wu_manber


def test_exact_dedup(spark):
    rows = [(1, "a b c"), (2, "abc "), (3, "a  b  c"), (4, None), (5, ""), (6, " \t"), (7, "xyz"), (7, "xyz"), (None, "abc"), (8, "q" * 100_000), (9, "q" * 100_000 + " "), (10, "Abc")]
    for mode in (True, False):
        out = exact_dedup.exact_dedup(docs(spark, rows), digest_all=mode).collect()
        assert len(out) == len(rows)
        groups = defaultdict(list)
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
        keep = {m[3]: (min(g)[3], len(g), k) for k, g in groups.items() for m in g}
        for r in out:
            best, n, k = keep[r.doc_id]
            assert (r.keep_id, r.group_size) == (best, n)
            if mode:
                assert r.text_sha256 == hashlib.sha256(k.encode()).hexdigest()
        assert sum(r.kept for r in out) == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "e"), (5002, "one two", "f"), (5002, "one two", "f")]
    df = docs(spark, rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    size = defaultdict(int)
    source = {}
    for i, t, s in rows:
        size[s] += len((t or "").split())
        source[i] = s
    target, taken, largest = reshared(size), defaultdict(int), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6, s
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


def test_decontamination(spark):
    rng = random.Random(5)
    vocab = ["Ab", "b", "c", "dé", "e1", "f", "gg"]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, sentence(rng.randint(8, 30))) for i in range(30)] + [(30, None), (31, "..."), (32, "zz top"), (33, "zz"), (33, "zz"), (100, "one TWO three")]
    rows = [(i, sentence(rng.randint(0, 300))) for i in range(40)]
    rows += [(100 + i, sentence(40) + ". " + items[i][1].upper() + ", " + sentence(9)) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "a zz-TOP b"), (203, "zz"), (203, "zz"), (204, "x" * 50_000 + " one two THREE"), (205, items[0][1][: len(items[0][1]) // 2]), (206, items[0][1])]
    df = docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *hits(t, items)) for i, t in rows)
    for block in (5000, 7):
        found = wu_manber.find_benchmark(df, bench, block_items=block)
        assert sorted((r.row.doc_id, r.n_words, sum(x.end - x.start for x in r.spans), len(r["items"])) for r in found.collect()) == [w[:4] for w in want]
    assert sorted(map(tuple, wu_manber.contamination(df, bench).collect())) == want
    odd = df.selectExpr("doc_id", "text", "1 AS spans", "'x' AS items", "2 AS n_words", "3 AS row", "4 AS hits")
    assert wu_manber.decontaminate(odd, bench).columns == odd.columns
    clean = wu_manber.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    assert wu_manber.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert wu_manber.contamination(docs(spark, []), bench).count() == 0
