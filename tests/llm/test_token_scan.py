"""Separator scan: exact round trips and plain counts."""

import random

import numpy as np
from common import docs

from tickframe.llm import token_scan


def test_token_counts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "Zeit", "été", "x1", "\n"]) for _ in range(rng.randint(0, 400)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "<|endoftext|> word"), (303, "q" * 100_000), (304, "same"), (304, "same"), (None, "no id")]
    encoder, _ = token_scan.load_encoder(open(token_scan.VOCABULARY, "rb").read())
    want = sorted(((i, len(token_scan.encode(encoder, t or ""))) for i, t in rows), key=str)
    for block in (token_scan.BLOCK_TOKENS, 64):
        got = token_scan.token_counts(docs(spark, rows).repartition(4), block_tokens=block).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert token_scan.token_counts(docs(spark, [])).count() == 0


def test_flat_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "GROUP", 3)
    rng = np.random.default_rng(1)
    want = []
    for f in range(5):
        lengths = rng.integers(0, 90, rng.integers(0, 40))
        tokens = [x for n in lengths for x in [*rng.integers(1, 50, n), 0]]
        rest = int(rng.integers(0, 3)) * 30
        tokens += [7] * rest
        np.array(tokens, "<u2").tofile(tmp_path / f"{f}.bin")
        want += [(f, k, int(n), True) for k, n in enumerate(lengths)] + [(f, len(lengths), rest, False)] * (rest > 0)
    for size in (16, 1000):
        blocks = token_scan.read_token_files(spark, str(tmp_path), 2, size)
        got = [(int(r.file.rsplit("/", 1)[1][0]), r.ordinal, r.n_tokens, r.terminated) for r in token_scan.document_lengths(blocks, 0, size, 2).collect()]
        assert sorted(got) == sorted(want)
