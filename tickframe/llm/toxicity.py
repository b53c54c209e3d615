"""Toxicity by noisy-channel deobfuscation.

Obfuscated words are restored before they are scored. Every character of a token opens a
column of a lattice: a leetspeak character stands for the letters it may replace, the
second of two equal characters may be dropped (longer repetitions count as two), a
separator between single letters may be dropped, and blanks between single letters may be
dropped or kept as word boundaries. A Viterbi search under a character bigram model finds
the best restored text. The model is counted over all documents, plus the words that
labelled toxic documents favour, so a restored toxic word is likelier than noise.

Restored words are looked up in a lexicon of log odds learned from labelled rows, and a
logistic regression on what is found gives the score.

Tokens without any choice have one path and are their own restoration; equal tokens of a
batch are decoded once.

Defined cases: null and empty texts get the score of a text without any lexicon word;
repeated rows get equal scores; without labels of both kinds the lexicon is empty and the
score is the smoothed share of label 1 (0.5 without labels); an empty table gives an empty
result; only doc_id and text of ``docs`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as bt
from .cluster import cut, fold, prepare
from .labelled import MAX_TRAINING_ROWS, fit_logistic, sigmoid, training_rows

#: The letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou"}
SEPARATORS = b".-_*~'\"/\\,;:^`"
BOUNDARY, SKIP, NONE = 0, 27, 28
WIDTH = 5
MAX_LEXICON = 5000

LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
IS_LEET = np.zeros(256, dtype=bool)
IS_LEET[[ord(c) for c in LEET]] = True
IS_DIGIT = np.zeros(256, dtype=bool)
IS_DIGIT[48:58] = True
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True
BLANK = ~bt.NOT_BLANK
#: Bytes that end a token: everything that is neither a letter, a digit nor beyond ASCII.
TRAILING = ~(LETTER | IS_DIGIT)
TRAILING[128:] = False
#: Bytes that can't begin one: those, but $ and @ can.
LEADING = TRAILING.copy()
LEADING[[ord("$"), ord("@")]] = False

#: Options of a byte: letter codes 1-26, BOUNDARY, SKIP, or NONE; and what each costs.
OPTIONS = np.full((256, WIDTH), NONE, dtype=np.int8)
COST = np.zeros((256, WIDTH), dtype=np.float32)
OPTIONS[:, 0] = BOUNDARY
for _c in range(26):
    OPTIONS[97 + _c, 0] = _c + 1
for _c, _letters in LEET.items():
    OPTIONS[ord(_c), : len(_letters)] = [ord(x) - 96 for x in _letters]
    COST[ord(_c)] = -np.log(len(_letters))
for _c in SEPARATORS:
    if OPTIONS[_c, 0] == BOUNDARY:
        OPTIONS[_c, :2] = SKIP, BOUNDARY
        COST[_c, :2] = -0.5, -2.0
for _c in np.flatnonzero(BLANK):
    OPTIONS[_c, :2] = SKIP, BOUNDARY
    COST[_c, :2] = -1.0, -3.0
DROP_COST = np.float32(-3.0)
#: The letter that a byte stands for, where there is only one; for finding repetitions.
CANON = np.arange(256, dtype=np.uint8)
CANON[[ord(c) for c, x in LEET.items() if len(x) == 1]] = [ord(x) for x in LEET.values() if len(x) == 1]

SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[97:123] = np.arange(1, 27)


def char_counts(docs: DataFrame) -> np.ndarray:
    """27 x 27 counts of neighbouring symbols (a-z; 0 is anything else) over all texts."""

    def run(batches):
        total = np.zeros(27 * 27, np.int64)
        for b in batches:
            data, offsets = bt.flat(b["text"])
            for i, j in bt.slices(offsets):
                s = SYMBOL[bt.LOWER[data[offsets[i] : offsets[j]]]]
                total += np.bincount(s[:-1] * 27 + s[1:], minlength=27 * 27)[: 27 * 27]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27), pa.int32()), pa.array(total)], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(27 * 27)
    for r in rows:
        counts[r.code] = r.n
    return counts.reshape(27, 27)


def char_model(counts: np.ndarray, words: list[str], boost: float = 0.1) -> np.ndarray:
    """Log P(next | symbol); ``words`` get the share ``boost`` of all counts."""
    extra = np.zeros((27, 27))
    for w in words:
        s = [0, *(ord(c) - 96 for c in w if "a" <= c <= "z"), 0]
        np.add.at(extra, (s[:-1], s[1:]), 1)
    total = counts + 0.5
    if extra.sum():
        total = total + extra * (boost * total.sum() / extra.sum())
    return np.log(total / total.sum(1, keepdims=True)).astype(np.float32)


def viterbi(options: np.ndarray, cost: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Best emission codes (BOUNDARY, letter or SKIP) for lattices of one length, all at once.

    options, cost: (lattices, columns, WIDTH); columns past the end have the one option SKIP.
    """
    n, length, width = options.shape
    best = np.full((n, 27), -np.inf, np.float32)
    best[:, BOUNDARY] = 0
    came = np.zeros((length, n, 27), np.int8)  # the state before
    took = np.zeros((length, n, 27), np.int8)  # the emission
    rows = np.arange(n)
    state = np.arange(27, dtype=np.int8)
    for k in range(length):
        new = np.full((n, 27), -np.inf, np.float32)
        for a in range(width):
            code = options[:, k, a]
            skip = code == SKIP
            if skip.any():
                score = np.where(skip[:, None], best + cost[:, k, a, None], -np.inf)
                better = score > new
                new = np.where(better, score, new)
                came[k] = np.where(better, state, came[k])
                took[k][better] = SKIP
            emit = np.flatnonzero(code < SKIP)
            if not len(emit):
                continue
            c = code[emit]
            step = best[emit] + model.T[c]
            before = step.argmax(1)
            score = step[np.arange(len(emit)), before] + cost[emit, k, a]
            better = score > new[emit, c]
            emit, c, before, score = emit[better], c[better], before[better], score[better]
            new[emit, c] = score
            came[k, emit, c] = before
            took[k, emit, c] = c
        best = new
    at = (best + model[:, BOUNDARY]).argmax(1)
    out = np.empty((n, length), np.int8)
    for k in range(length - 1, -1, -1):
        out[:, k] = took[k, rows, at]
        at = came[k, rows, at]
    return out


def restore(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Restored bytes of each span of lower-cased ``data``, each followed by a blank, and their offsets."""
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length)])
    flat = data[np.repeat(starts - at[:-1], length) + np.arange(at[-1])]
    owner = np.repeat(np.arange(len(starts)), length)
    first = np.zeros(len(flat) + 1, dtype=bool)
    first[at] = True
    equal = np.zeros(len(flat), dtype=bool)
    equal[1:] = (CANON[flat[1:]] == CANON[flat[:-1]]) & ~first[1:-1]
    third = equal.copy()
    third[1:] &= equal[:-1]
    flat, owner, equal = flat[~third], owner[~third], equal[~third]
    count = np.bincount(owner, minlength=len(starts))
    at = np.concatenate([[0], np.cumsum(count)])
    pieces: list = [None] * len(starts)
    size = 8
    left = np.argsort(count, kind="stable")
    while len(left):
        n = int(np.searchsorted(count[left], size, "right"))
        for some in np.array_split(left[:n], -(-n * size // 200_000)) if n else []:
            k = np.arange(size)
            inside = k < count[some][:, None]
            place = np.minimum(at[some][:, None] + k, max(len(flat) - 1, 0))
            options, cost = OPTIONS[flat[place]], COST[flat[place]]
            options[~inside] = [SKIP, *[NONE] * (WIDTH - 1)]
            cost[~inside] = 0
            # The second of two equal characters may go.
            again = inside & equal[place]
            options[again, WIDTH - 1] = SKIP
            cost[again, WIDTH - 1] = DROP_COST
            codes = viterbi(options, cost, model)
            for row, code in zip(some.tolist(), codes, strict=True):
                pieces[row] = code[code != SKIP]
        left = left[n:]
        size *= 2
    codes = np.concatenate([x for p in pieces for x in (p, [BOUNDARY])]) if pieces else np.zeros(0, np.int8)
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    letters = np.where(codes == BOUNDARY, 32, codes.astype(np.int16) + 96).astype(np.uint8)
    return letters, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def stripped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without punctuation at either end; empty ones are left out."""
    starts, ends = bt.spans(bt.NOT_BLANK[data], offsets)
    for at, side, step in ((starts, 0, 1), (ends, 1, -1)):
        going = np.arange(len(starts))
        while len(going):
            byte = data[at[going] - side]
            going = going[(starts[going] < ends[going]) & (TRAILING if side else LEADING)[byte]]
            at[going] += step
            going = going[starts[going] < ends[going]]
    some = starts < ends
    return starts[some], ends[some]


def restored_words(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, restored) of the words of the deobfuscated texts."""
    starts, ends = stripped(data, offsets)
    code, owner = bt.hashes(data, starts, ends), bt.owners(starts, offsets)
    if not len(code):
        return code, owner, np.zeros(0, bool)
    # A token has a choice if it mixes letters with leetspeak or separators, or repeats a letter.
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    odd = np.concatenate([[0], np.cumsum(IS_LEET[data] | IS_SEPARATOR[data])])
    twice = np.zeros(len(data) + 1, np.int64)
    twice[2:] = np.cumsum(data[1:] == data[:-1])
    has_letter = letters[ends] > letters[starts]
    choice = has_letter & ((odd[ends] > odd[starts]) | (twice[ends] > twice[np.minimum(starts + 1, ends)]))
    kinds, first, place = np.unique(code, return_index=True, return_inverse=True)
    decode = np.flatnonzero(choice[first])
    out_code, out_owner, was = [code[~choice]], [owner[~choice]], [np.zeros(int((~choice).sum()), bool)]
    if len(decode):
        text, at = restore(data, starts[first[decode]], ends[first[decode]], model)
        s, e = bt.spans(text != 32, at)
        h, of = bt.hashes(text, s, e), bt.owners(s, at)
        lo = np.searchsorted(of, np.arange(len(decode) + 1))
        slot = np.full(len(kinds), -1)
        slot[decode] = np.arange(len(decode))
        mine = slot[place[choice]]
        count = lo[mine + 1] - lo[mine]
        out_code.append(h[np.repeat(lo[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())])
        out_owner.append(np.repeat(owner[choice], count))
        was.append(np.ones(int(count.sum()), bool))
    # Single letters in a row: their blanks join the lattice.
    single = (ends - starts == 1) & (LETTER | IS_LEET)[data[starts]]
    edge = np.ones(len(single), bool)
    edge[1:] = ~single[:-1] | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(single & edge)
    last = np.ones(len(single), bool)
    last[:-1] = ~single[1:] | (owner[1:] != owner[:-1])
    stop = np.flatnonzero(single & last)
    long = stop - begin >= 2
    begin, stop = begin[long], stop[long]
    if len(begin):
        text, at = restore(data, starts[begin], ends[stop], model)
        s, e = bt.spans(text != 32, at)
        out_code.append(bt.hashes(text, s, e))
        out_owner.append(owner[begin][bt.owners(s, at)])
        was.append(np.ones(len(s), bool))
    return np.concatenate(out_code), np.concatenate(out_owner), np.concatenate(was)


class Detector:
    """The character model, the lexicon and the weights of the regression."""

    def __init__(self, model: np.ndarray, words: list[str], odds: np.ndarray, weights: np.ndarray | None = None, prior: float = 0.5):
        self.model, self.words, self.prior, self.weights = model, words, prior, weights
        data = [w.encode() for w in words]
        at = np.cumsum([0, *map(len, data)])
        code = bt.hashes(np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:])
        # A word is also known by its restored form, which may have lost a double letter.
        text, rest = restore(np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:], model)
        code = np.concatenate([code, bt.hashes(text, rest[:-1], rest[1:] - 1)])
        long = np.concatenate([np.ones(len(words), bool), rest[1:] - rest[:-1] > 3])
        self.code, first = np.unique(code[long], return_index=True)
        self.word = np.tile(np.arange(len(words)), 2)[long][first]
        self.odds = np.asarray(odds, float)

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: sum and maximum of the odds of distinct lexicon words, and how many words hit."""
        data, offsets = bt.flat(column)
        out = np.zeros((len(offsets) - 1, 4))
        if not len(self.code):
            return out
        for i, j in bt.slices(offsets):
            seg, at = bt.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            code, owner, _ = restored_words(seg, at, self.model)
            place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            hit = self.code[place] == code
            place, owner, n = self.word[place[hit]], owner[hit], j - i
            kinds = np.unique(owner * len(self.words) + place)
            of, odds = kinds // len(self.words), self.odds[kinds % len(self.words)]
            total, count = np.bincount(of, odds, n), np.bincount(owner, minlength=n)
            top = np.zeros(n)
            np.maximum.at(top, of, odds)
            out[i:j] = np.stack([np.minimum(total, 30) / 10, top / 5, np.log1p(np.bincount(of, minlength=n)), np.log1p(count)], axis=1)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.features(column)
        if self.weights is None:
            return np.full(len(x), self.prior)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _word_rows(batches):
    """Distinct plain words (a-z only, stripped) of each labelled text."""
    for b in batches:
        data, offsets = bt.flat(b["text"])
        data = bt.LOWER[data]
        starts, ends = stripped(data, offsets)
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        plain = (letters[ends] - letters[starts] == ends - starts) & (ends - starts >= 3)
        starts, ends = starts[plain], ends[plain]
        owner = bt.owners(starts, offsets)
        _, first = np.unique(bt.mix(bt.hashes(data, starts, ends) + owner.astype(np.uint64) * bt.BASE), return_index=True)
        text = data.tobytes()
        words = [text[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        label = b["label"].to_numpy()[owner[first]]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(label, pa.int32())], names=["word", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, max_rows: int = MAX_TRAINING_ROWS) -> Detector:
    """Character model over all documents; lexicon and weights from at most ``max_rows`` labelled ones."""
    prepare(docs.sparkSession)
    rows = cut(training_rows(docs, labels, label, folds, held_out, max_rows))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = n.get(0, 0), n.get(1, 0)
    counts = char_counts(docs)
    if not good or not bad:
        return Detector(char_model(counts, []), [], [], prior=(bad + 1) / (good + bad + 2))
    words = rows.groupBy("text").agg(F.max("label").alias("label")).mapInArrow(_word_rows, "word string, label int").groupBy("word")
    words = words.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    a, b = (F.col("a") + 0.1) / (bad + 0.2), (F.col("b") + 0.1) / (good + 0.2)
    # Favoured by toxic documents beyond chance: at least four standard errors of the log odds, and 20 to 1.
    odds = F.log(a / (1 - a)) - F.log(b / (1 - b))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = words.select("word", odds.alias("odds"), (odds / error).alias("z")).filter((F.col("z") >= 4) & (F.col("odds") >= 3)).orderBy(F.desc("z"), "word").limit(MAX_LEXICON).collect()
    lexicon = [r.word for r in best]
    detector = Detector(char_model(counts, lexicon), lexicon, [r.odds for r in best])
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        for batch in batches:
            x = shared.value.features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], bt.list_column(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64())], names=["doc_id", "label", "x"])

    found = rows.mapInArrow(run, "doc_id long, label int, x array<double>").toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    x = np.array(found["x"].combine_chunks().flatten()).reshape(len(found), -1)
    detector.weights = fit_logistic(x[order], found["label"].to_numpy()[order].astype(float))
    return detector


def score_toxicity(docs: DataFrame, detector: Detector, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        for b in batches:
            score = shared.value.score(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, detector: Detector) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with their columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b["text"]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
