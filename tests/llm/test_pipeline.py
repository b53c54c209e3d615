"""The pipeline's stages, each against brute force on what the stage before kept."""

import random
from collections import defaultdict

from common import DOCS, hits, repeated_lines, reshared, shingles, union_find

import corpus_pipeline
from tickframe.llm import toxicity


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(1500)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, line(14)) for k in range(6)]
    footer = line(9)
    rows = []
    for i in range(260):
        lines = [line(rng.randint(3, 25)) for _ in range(rng.randint(1, 5))]
        if i % 6 == 0:
            lines.insert(0, lines[0] + " idiot moron stupid")
        if i % 4 == 0:
            lines.append(footer)
        if i % 13 == 0:
            lines.append("so " + items[i % 6][1] + " it goes")
        rows.append((i, "\n".join(lines), "en", rng.choice(["a", "a", "b", "c", None]), 0))
    base = [w for _, t, *_ in rows[:1] for w in line(90).split()]
    for k, width in enumerate((7, 9, 13, 18, 29, 43)):  # near copies whose lines are too different for the line stage
        words = list(base)
        words[k * 7] = "other"
        rows.append((400 + k, "\n".join(" ".join(words[i : i + width]) for i in range(0, 90, width)), "en", "a", 0))
    rows += [(500, None, "en", "a", 0), (501, "", "en", "b", 0), (502, footer, "en", "b", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] < 260 and r[0] % 6 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    detector = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, detector).collect() if r.predicted}
    assert bad == {r[0] for r in rows if r[0] < 260 and r[0] % 6 == 0}
    want = {r[0]: (r[1], r[3]) for r in rows if r[0] not in bad}

    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line dedup", "near-duplicate documents", "benchmark decontamination", "source mix"]
    states = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS, name
        states.append(docs.collect())
    text = lambda s: {r.doc_id: r.text for r in s}
    assert text(states[0]) == {i: t for i, (t, _) in want.items()}

    gone, _ = repeated_lines([(i, t) for i, (t, _) in want.items()])
    left = {}
    for i, (t, s) in want.items():
        kept = t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if i not in gone or kept.strip():
            left[i] = (kept, s)
    assert text(states[1]) == {i: t for i, (t, _) in left.items()} and 502 not in left
    assert all(r.n_chars == len(r.text) for r in states[1] if r.doc_id in gone)

    sets = {i: shingles(t, 5) for i, (t, _) in left.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = union_find(ids, links)
    assert links and text(states[2]) == {i: left[i][0] for i in ids if group[i] == i}

    clean = {i: left[i] for i in ids if group[i] == i and not hits(left[i][0], items)[4]}
    assert text(states[3]) == {i: t for i, (t, _) in clean.items()} and len(clean) < len(states[2])

    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for t, s in clean.values():
        size[s] += len((t or "").split())
    target = reshared(size)
    assert {r.doc_id for r in states[4]} == set(clean)
    for r in states[4]:
        s = clean[r.doc_id][1]
        assert r.taken <= 2 * r.size and abs(r.target - target[s]) < 1e-6 * target[s] + 1e-9
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, states[4]))
