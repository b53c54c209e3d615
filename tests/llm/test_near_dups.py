"""Components, near-duplicate documents and fuzzy lines against brute force."""

import random

import pytest
from common import docs, repeated_lines, shingles, union_find

from tickframe.llm import fuzzy_lines, graph, minhash_forest, neighbours


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert all(got.get(x, x) == want[x] for x in want) and set(got) <= set(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 200, 400]))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words) if rng.random() < 0.7 else "  ".join(words).upper()))
            n += 1
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(60):  # a crowded region
        words = list(base)
        words[rng.randrange(150)] = rng.choice(vocab)
        rows.append((n, " ".join(words)))
        n += 1
    rows += [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two"), (9005, "ONE  two"), (9006, "one"), (9007, "a a a a a a"), (9008, "a a a a a a a a"), (9009, "long " * 50_000), (9009, "long " * 50_000)]
    sets = {i: shingles(t, 4) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(ids, links)
    out = minhash_forest.near_duplicates(docs(spark, [*rows, (None, "one two")])).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    kept = minhash_forest.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len({r.doc_id for r in kept.collect()}) == kept.count()  # of the row that is there twice, one
    odd = docs(spark, rows[:20]).selectExpr("cast(doc_id AS int) AS doc_id", "text", "1 AS _kept", "2 AS id", "3 AS hash", "4 AS row", "5 AS _id", "6 AS _hash", "7 AS `a.b`")
    assert {tuple(r)[2:] for r in minhash_forest.drop_near_duplicates(odd).collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    assert minhash_forest.near_duplicates(docs(spark, [])).count() == 0


def test_one_id_for_two_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "pq")
    out = minhash_forest.near_duplicates(docs(spark, [(1, a), (1, b), (2, b + " more"), (3, "else entirely different words here")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("n, block, limit", [(30, 1024, 1 << 14), (300, 64, 100), (3000, 1024, 1 << 14)])
def test_star(spark, monkeypatch, n, block, limit):
    """Variants that are each linked with the first document, and hardly with each other, are one component."""
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    monkeypatch.setattr(neighbours, "LIMIT", limit)
    rng = random.Random(n)
    base = [f"b{k}" for k in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        words = list(base)
        for k in rng.sample(range(4, 96), 2):
            words[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 4) for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets)
    out = minhash_forest.near_duplicates(docs(spark, rows).repartition(4))
    assert {r.component_id for r in out.collect()} == {0}


def test_fuzzy_lines(spark):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(2000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 60))] for _ in range(60)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            lines.append(rng.choice([" ", "  "]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
            if rng.random() < 0.2:
                lines.append("")
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "a b c d e\nA B  C D E\nx"), (504, "x " * 30_000 + "\ny"), (505, "x " * 30_000), (506, "q w e r t"), (506, "q w e r t")]
    df = docs(spark, rows)
    gone, links = repeated_lines(rows)
    assert links and gone
    out = fuzzy_lines.drop_lines(df)
    assert out.columns == [*df.columns, "_lines", "_removed"]
    got = sorted(((r.doc_id, r.text, r["_removed"]) for r in out.collect()), key=str)
    want = sorted(((i, t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone.get(i, ()))) for i, t in rows), key=str)
    want[want.index((506, "q w e r t", 0))] = (506, "", 1)  # the repeated row loses its lines
    assert got == sorted(want, key=str)
    odd = df.selectExpr("cast(doc_id AS int) AS doc_id", "text", "1 AS _id", "2 AS _row", "3 AS _gone", "4 AS _hash", "5 AS _lines", "6 AS _removed", "7 AS `a.b`", "8 AS id", "9 AS hash", "10 AS n_lines", "11 AS row", "12 AS _text")
    out = fuzzy_lines.drop_lines(odd)
    assert out.columns == [*odd.columns, "__lines", "__removed"]
    assert sorted(((r.doc_id, r.text, r["__removed"]) for r in out.collect()), key=str) == got
    assert {tuple(r)[2:14] for r in out.collect()} == {tuple(range(1, 13))}
    assert fuzzy_lines.drop_lines(docs(spark, [])).count() == 0
