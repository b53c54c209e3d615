"""Learned scores: decoding against brute force, held-out accuracy, and exact base scores."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from common import docs, lower

from tickframe.llm import bytestext as bt
from tickframe.llm import context_mixing, quality, toxicity
from tickframe.llm.labelled import auc

BAD = ["idiot", "moron", "stupid"]
GOOD = ["table", "window", "garden", "letter", "paper", "river", "stone", "music", "summer", "winter", "bottle", "yellow"]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_viterbi():
    rng = np.random.default_rng(0)
    model = np.log(rng.dirichlet(np.ones(27), 27)).astype(np.float32)
    for text in ("1d10t", "st*p", "a b", "aab", "o0o"):
        data = np.frombuffer(text.encode(), np.uint8)
        flat, _ = toxicity.restore(data, np.array([0]), np.array([len(data)]), model)
        columns = []
        for k, c in enumerate(data):
            some = [(int(o), float(x)) for o, x in zip(toxicity.OPTIONS[c], toxicity.COST[c], strict=True) if o != toxicity.NONE]
            if k and toxicity.CANON[c] == toxicity.CANON[data[k - 1]]:
                some.append((toxicity.SKIP, float(toxicity.DROP_COST)))
            columns.append(some)

        def value(path):
            score, last = 0.0, 0
            for o, x in path:
                score += x
                if o != toxicity.SKIP:
                    score, last = score + model[last, o], o
            return score + model[last, 0]

        best = max(itertools.product(*columns), key=value)
        want = "".join(" " if o == 0 else chr(96 + o) for o, _ in best if o != toxicity.SKIP)
        assert bytes(flat).decode()[:-1] == want, text


def test_toxicity(spark):
    rng = random.Random(1)
    twist = {"idiot": "1d10t", "moron": "m 0 r o n", "stupid": "stuuup1d"}
    rows, labels, plain = [], [], {}
    for i in range(1500):
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 40))]
        toxic = i % 5 == 0
        hidden = toxic and rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            w = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), twist[w] if hidden else w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
        plain[i] = hidden
    extra = [(5000, None), (5001, ""), (5002, "!!! ... 123"), (5003, "garden " * 20_000), (5004, "you 1d10t, you m.o.r.o.n"), (5004, "you 1d10t, you m.o.r.o.n"), (None, "stupid idiot")]
    df = docs(spark, [*rows, *extra])
    lab = labelled(spark, [*labels, (None, 1, 1), (7000, 0, None), (0, 1, 0)])
    detector = toxicity.train(df, lab)
    assert set(detector.words) == set(BAD)
    out = toxicity.score_toxicity(df, detector).collect()
    assert len(out) == len(rows) + len(extra)
    score = {r.doc_id: r for r in out}
    for i, _, t in labels:
        assert score[i].held_out == (crc(i, 5) == 0) and score[i].predicted == t == int(score[i].score >= 0.5), (i, plain[i])
    assert score[5004].predicted == 1 and score[None].predicted == 1 and not any(score[k].predicted for k in (5000, 5001, 5002, 5003))
    clean = toxicity.drop_toxic(df, detector)
    assert clean.columns == df.columns and clean.filter("doc_id >= 5000 or doc_id is null").count() == 4
    none = toxicity.train(df, lab.limit(0))
    assert {r.score for r in toxicity.score_toxicity(df, none).collect()} == {0.5}
    assert toxicity.score_toxicity(df.limit(0), detector).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 60))]
        kind = rng.choice(["fine", "fine", "shout", "bars"])
        text = {"fine": " ".join(words) + ".", "shout": " ".join(w.upper() + "!!" for w in words), "bars": " | ".join(words)}[kind]
        rows.append((i, text))
        labels.append((i, int(kind == "fine"), 0))
    extra = [(5000, None), (5001, ""), (5002, "x" * 300_000), (5003, "same"), (5003, "same"), (None, "a b")]
    df = docs(spark, [*rows, *extra])
    trees = quality.train(df, labelled(spark, labels))
    out = quality.score_quality(df, trees).collect()
    assert len(out) == len(rows) + len(extra)
    score = {r.doc_id: r for r in out}
    held = [(score[i].score, q) for i, q, _ in labels if crc(i, 3) == 1]
    assert auc(np.array([s for s, _ in held]), np.array([q for _, q in held])) > 0.99
    assert all(score[i].held_out == (crc(i, 3) == 1) for i, _, _ in labels) and score[5000].score == score[5001].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    # The flat arrays against a walk down each tree.
    x = quality.batch_statistics(pa.array([t for _, t in rows[:20]]))
    for row, s in zip(x, trees.score(x), strict=True):
        total = trees.prior
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += float(v[node - len(f)])
        assert math.isclose(s, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert {r.score for r in quality.score_quality(df, quality.train(df, labelled(spark, []))).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), trees).count() == 0


def test_statistics_of_parts():
    """A text's statistics don't depend on its neighbours in a batch."""
    texts = ["One two. THREE", "", "a\n\na\nb", "é" * 10, "x " * 2000]
    together = quality.batch_statistics(pa.array(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.batch_statistics(pa.array([t]))[0], row)


def test_context_mixing(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "HEAD", 40)
    monkeypatch.setattr(context_mixing, "SYMBOLS", 16)
    rng = random.Random(3)
    follow = {w: rng.sample(GOOD, 3) for w in GOOD}
    rows = []
    for i in range(700):
        w, words = rng.choice(GOOD), []
        for _ in range(rng.randint(0, 60)):
            words.append(w if rng.random() > 0.1 else f"rare{rng.randrange(300)}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, "Unseen WORDS only"), (5003, "garden " * 30_000), (5004, "table"), (5004, "table"), (None, "table window")]
    df = docs(spark, rows)
    out = context_mixing.score_split(df).collect()
    assert len(out) == len(rows)
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    count = Counter(w for t in train for w in words_of(t))
    n, v, ends = sum(count.values()) + len(train), len(count) + 1, len(train)
    got = {r.doc_id: r for r in out}
    for i, t in rows:
        w, r = words_of(t), got[i]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in out if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert context_mixing.score_split(docs(spark, [])).count() == 0


def test_context_counts_hold_every_training_document(spark, monkeypatch):
    """Counts, and the score of a text, against plain loops."""
    monkeypatch.setattr(context_mixing, "SYMBOLS", 12)
    monkeypatch.setattr(context_mixing, "BLOCK_BITS", 16)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(GOOD, k=rng.randint(0, 40)))) for i in range(300)]
    _, v, model = context_mixing.learn(docs(spark, rows))
    token = lambda t: context_mixing.Tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), v)
    count = Counter()
    for _, t in rows:
        _, bit, slots = token(t).bits(v)
        count.update((int(x), int(b)) for s in slots for x, b in zip(s, bit, strict=True))
    for slot in {x for x, _ in count}:
        z, o = count[slot, 0], count[slot, 1]
        assert math.isclose(model.logit[slot], math.log((o + 0.4) / (z + 0.4)), rel_tol=2e-3, abs_tol=2e-3)
        assert model.gate[slot] == min(math.ceil(math.log2(z + o + 1)) / 2, context_mixing.GATES - 1) // 1
    assert (np.abs(model.weights - 1 / context_mixing.K) > 1e-3).any()
    text = " ".join(rng.choices([*GOOD, "unseen"], k=50))
    _, bit, slots = token(text).bits(v)
    extra, want = np.zeros(context_mixing.K), 0.0
    for lo in range(0, len(bit), 16):
        change = np.zeros(context_mixing.K)
        for n in range(lo, min(lo + 16, len(bit))):
            x = np.array([float(model.logit[s[n]]) for s in slots])
            w = np.array([float(model.weights[k, model.gate[s[n]]]) for k, s in enumerate(slots)])
            p = 1 / (1 + math.exp(-float(((w + extra) * x).sum())))
            want += math.log(p if bit[n] else 1 - p)
            change += ((1 if bit[n] else 0) - p) * x
        extra += context_mixing.RATE / 16 * change
    whole = model.score(token(text), v)[0]
    assert math.isclose(whole, want, rel_tol=1e-3)
    # In chunks of a few tokens, and among other texts, it gets the same score.
    monkeypatch.setattr(context_mixing, "CHUNK", 7)
    monkeypatch.setattr(context_mixing.Tokens.bits, "__defaults__", (0, 7))
    parts = [rows[5][1], text, "", text, rows[8][1]]
    data, at = bt.flat(pa.array(parts))
    got = model.score(context_mixing.Tokens(data, at, v), v)
    assert np.allclose(got[[1, 3]], whole, rtol=1e-5)


def test_gates_learn_which_input_to_trust():
    rng = np.random.default_rng(5)
    n = 200_000
    truth = rng.normal(size=n) * 2
    bit = (rng.random(n) < 1 / (1 + np.exp(-truth))).astype(np.float32)
    x = rng.normal(size=(context_mixing.K, n)).astype(np.float32)
    x[2] = truth
    gate = np.zeros((context_mixing.K, n), np.int8)
    gates = context_mixing.Gates()
    for lo in range(0, n, 50_000):
        gates.read(x[:, lo : lo + 50_000], gate[:, lo : lo + 50_000], bit[lo : lo + 50_000])
    want = np.zeros(context_mixing.K)
    want[2] = 1
    assert np.abs(gates.weights[:, 0] - want).max() < 0.1 and gates.seen[:, 0].tolist() == [n] * context_mixing.K


def test_ids_of_other_kinds(spark):
    rows = docs(spark, [(i, f"{rng_word} {BAD[i % 3] if i % 2 else GOOD[i % 12]}") for i, rng_word in enumerate(GOOD * 20)])
    labels = labelled(spark, [(i, i % 2, i % 2) for i in range(240)])
    small = lambda df: df.withColumn("doc_id", df.doc_id.cast("int"))
    for train, score in ((toxicity.train, toxicity.score_toxicity), (quality.train, quality.score_quality)):
        got = score(small(rows), train(small(rows), small(labels)))
        assert dict(got.dtypes)["doc_id"] == "bigint" and got.count() == 240


def test_probabilities_add_up():
    """The symbols' probabilities in a context sum to one."""
    words = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64))
    v = context_mixing.Vocabulary(words, np.arange(50, 0, -1), 10, 1275, 50)
    size = len(v.at) - 1
    total = sum(2.0 ** -(v.at[s + 1] - v.at[s]) for s in range(size))
    assert math.isclose(total, 1.0)
    rng = np.random.default_rng(2)
    p = rng.random(v.node.max() + 1)
    assert math.isclose(sum(np.prod(np.where(v.bit[v.at[s] : v.at[s + 1]] > 0, p[v.node[v.at[s] : v.at[s + 1]]], 1 - p[v.node[v.at[s] : v.at[s + 1]]])) for s in range(size)), 1.0)
    tail = v.counts[v.n_symbols :].sum() + (50 - v.n_symbols) + 1
    assert math.isclose(v.tail_log, math.log10(tail))


def test_word_hashes():
    texts = ["a b", "a", None, "b  A", "é\tx", "long" * 600_000, "  "]
    data, at = bt.flat(pa.array(texts))
    code, owner, start, end = bt.word_hashes(bt.LOWER[data], at)
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t))]
    assert [(k, bytes(bt.LOWER[data][s:e]).decode()) for k, s, e in zip(owner, start, end, strict=True)] == want
    assert len(set(code.tolist())) == len({w for _, w in want}) and code[0] == code[2] == code[4]
