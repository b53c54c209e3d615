"""Texts with long runs without blanks, or of blanks, have the tokens of the whole text."""

import random

from common import docs

from tickframe.llm import token_scan


def test_long_runs(spark):
    rng = random.Random(3)
    encoder, _ = token_scan.load_encoder(open(token_scan.VOCABULARY, "rb").read())
    words = ",".join(rng.choice(["https://ex.org/p", "zeit", "the", "word"]) + str(rng.randrange(10**6)) for _ in range(20_000))
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000))
    texts = [words, "so " + words, chinese, "".join(rng.choice("abcdefghij") for _ in range(400_000))]
    texts += ["a" + blanks + rest for blanks in (" " * 5000, "\n" * 5001, " \n" * 3000 + "　") for rest in ("", "b c", "1", "\x1cx", "'s")]
    rows = list(enumerate(texts))
    want = {i: len(encoder.encode_ordinary(t)) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_scan.token_counts(docs(spark, rows)).collect()} == want
    for _, t in rows:
        assert token_scan.encode(encoder, t).tolist() == encoder.encode_ordinary(t)
    assert len(token_scan.encode(encoder, "a" + " " * 1_000_000 + "b")) > 1  # the pattern alone fails here
