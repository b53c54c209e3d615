"""Language-model scoring by online logistic context mixing.

The tokens of a text are its words (lower-cased A-Z) and one end. The ``SYMBOLS`` most
frequent training tokens are symbols with a Huffman code; every other word is an escape
symbol followed by its share of the remaining training counts (add one). So a token is a
few binary decisions, and each bit is predicted by several predictors that look up counts
of zeros and ones under a hashed context: none, the shape of the word before, the word
before, the two words before, and the last frequent word, each with the node of the code
tree. The predictions are combined in the logistic domain: weights are gated by how much
each predictor has seen, and are refined while a document is read, block by block, from
that document's own errors. A document's score is the log10 probability of its tokens.

Learning is in three passes over all training documents: exact word counts (a shuffled
sum), context counts (each task fills its tables, which are summed by table block), and the
gate weights. For these the documents are in two halves by a hash of their ids: each half is
read online against the context counts of the other, and the weights that the tasks reach
are averaged by how many bits each saw at that gate. Scoring uses the counts of both halves.
The context tables have a fixed size; the counts of the ``HEAD`` most frequent words are
broadcast, those of all other words are joined.

Defined cases: null and empty texts consist of the end alone; without training documents
every count is 0 and the score equals the base score; repeated rows get equal scores; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as bt
from .cluster import cut, fold, prepare, release

SYMBOLS = 4096
HEAD = 1 << 19
FREQUENT = 256
#: Bits of each predictor's table: none, shape, word, two words, last frequent word.
TABLE_BITS = (13, 18, 20, 20, 20)
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
K = len(TABLE_BITS)
GATES = 8
TABLE_BLOCK = 1 << 13
BLOCK_BITS = 256
#: Bytes of text whose tokens are held at once (a longer text stands alone), and tokens whose bits are.
SLICE = 1 << 19
CHUNK = 1 << 16
RATE = 0.02
#: Bits of one online step of the gate weights, and the least number of steps of a task.
STEP_BITS = 1 << 16
STEPS = 60
NODE_CODE = np.uint64(0x9E3779B97F4A7C15)
END_WORD = np.uint64(0x5851F42D4C957F2D)
LOG10 = np.log(10.0)


class Table:
    """Word hash -> index by open addressing, vectorised; -1 if absent."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(words)) * 4)))))
        size = 1 << int(64 - self.bits)
        self.slot = np.full(size + 64, -1, np.int32)
        at, todo = (words >> self.bits).astype(np.int64), np.arange(len(words), dtype=np.int32)
        while len(todo):
            free = self.slot[at] < 0
            _, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slot[at[chosen]] = todo[chosen]
            left = np.ones(len(todo), bool)
            left[chosen] = False
            todo, at = todo[left], at[left] + 1
            if len(at) and at.max() >= len(self.slot):
                self.slot = np.append(self.slot, np.full(1024, -1, np.int32))
        self.slot = np.append(self.slot, np.int32(-1))

    def find(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        if not len(self.words):
            return out
        at, todo = (words >> self.bits).astype(np.int64), np.arange(len(words))
        while len(todo):
            k = self.slot[at]
            same = (k >= 0) & (self.words[k] == words[todo])
            out[todo[same]] = k[same]
            more = (k >= 0) & ~same
            todo, at = todo[more], at[more] + 1
        return out


def huffman(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, node, bit): symbol s has the decisions node[at[s]:at[s+1]] with these bits."""
    heap = [(float(c) + 0.5, k, k) for k, c in enumerate(count)]
    heapq.heapify(heap)
    parent, side, n = {}, {}, len(count)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for x, bit in ((a, 0), (b, 1)):
            parent[x[2]], side[x[2]] = n, bit
        heapq.heappush(heap, (a[0] + b[0], n, n))
        n += 1
    at, node, bit = [0], [], []
    for s in range(len(count)):
        path = []
        while s in parent:
            path.append((parent[s] - len(count), side[s]))
            s = parent[s]
        node += [x for x, _ in reversed(path)]
        bit += [x for _, x in reversed(path)]
        at.append(len(node))
    return np.array(at, np.int64), np.array(node, np.int64), np.array(bit, np.float32)


class Vocabulary:
    """Counts of frequent words, the symbols and their code."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, docs: int, tokens: int, kinds: int):
        """docs: training documents; tokens, kinds: training words and distinct words, without ends."""
        order = np.lexsort((words, -counts))
        self.words, self.counts = words[order], counts[order].astype(np.float64)
        self.table = Table(self.words)
        self.n_symbols = min(SYMBOLS - 2, len(words))
        self.total, self.kinds = tokens + docs, kinds + (docs > 0)
        self.docs = docs
        self.base_log = np.log10(self.total + self.kinds + 1.0)
        in_symbols = self.counts[: self.n_symbols].sum()
        self.tail_log = np.log10(tokens - in_symbols + kinds - self.n_symbols + 1.0)
        self.end, self.escape = self.n_symbols, self.n_symbols + 1
        self.at, self.node, self.bit = huffman(np.concatenate([self.counts[: self.n_symbols], [docs, tokens - in_symbols + 1]]))


class Tokens:
    """The tokens of a few texts: word hashes, text index, index in the vocabulary (-1: not in it), symbols."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, v: Vocabulary):
        low = bt.LOWER[data]
        code, owner, starts, ends = bt.word_hashes(low, offsets)
        n = len(offsets) - 1
        size = len(code) + n
        place = np.arange(len(code)) + owner
        self.n = n
        self.first = np.append(bt.bounds(owner, n)[:-1] + np.arange(n), size)
        self.word = np.full(size, END_WORD, np.uint64)
        self.word[place] = code
        self.is_end = np.ones(size, bool)
        self.is_end[place] = False
        self.owner = np.repeat(np.arange(n), np.diff(self.first))
        self.index = np.full(size, -1, np.int64)
        self.index[place] = v.table.find(code)
        self.symbol = np.where((self.index >= 0) & (self.index < v.n_symbols), self.index, v.escape)
        self.symbol[self.is_end] = v.end
        self.shape = np.zeros(size, np.int64)
        if len(code):
            self.shape[place] = low[ends - 1].astype(np.int64) + 256 * np.minimum(ends - starts, 15)

    @cached_property
    def contexts(self) -> list[np.ndarray]:
        """A 64-bit context per predictor and token; it looks back within the text only."""
        size = len(self.word)
        start = np.zeros(size, bool)
        start[self.first[:-1]] = True

        def back(x, k):
            out = np.zeros(size, np.uint64)
            out[k:] = x[:-k]
            for j in range(k):
                at = self.first[:-1] + j
                out[at[at < self.first[1:]]] = 0
            return out

        one = back(self.word, 1)
        two = back(self.word, 2)
        shape = back(self.shape.astype(np.uint64), 1) * np.uint64(4099) + (self.symbol.astype(np.uint64)[np.maximum(np.arange(size) - 1, 0)] == np.uint64(self.symbol.max())).astype(np.uint64) * ~start
        frequent = np.where((self.symbol < FREQUENT) & ~self.is_end, np.arange(size), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], frequent[:-1]]))
        last = np.where(last >= self.first[self.owner], last, -1)
        fw = np.where(last >= 0, self.word[np.maximum(last, 0)], np.uint64(1))
        return [np.zeros(size, np.uint64), shape, bt.mix(one + np.uint64(1)), bt.mix(one * np.uint64(3) + bt.mix(two + np.uint64(2))), bt.mix(fw + np.uint64(5))]

    def bits(self, v: Vocabulary, first: int = 0, size: int = CHUNK):
        """(token, bit, slots) of ``size`` tokens from ``first`` on: slots[k] is the place in the joint table for predictor k."""
        symbol = self.symbol[first : first + size]
        count = v.at[symbol + 1] - v.at[symbol]
        token = np.repeat(np.arange(first, first + len(symbol)), count)
        where = np.repeat(v.at[symbol] - np.cumsum(count) + count, count) + np.arange(len(token))
        node, bit = v.node[where], v.bit[where]
        slots = [node & ((1 << TABLE_BITS[0]) - 1)]
        spread = (node.astype(np.uint64) + np.uint64(1)) * NODE_CODE
        for k, context in enumerate(self.contexts):
            if k:
                h = (context[token] ^ spread) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                slots.append((h >> np.uint64(64 - TABLE_BITS[k])).astype(np.int64) + STARTS[k])
        return token, bit, slots


class Model:
    """The learned tables: a prediction (logit) and a gate for every slot, and the gate weights."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        seen = zeros + ones
        prior = np.float32(0.4)
        self.logit = np.clip(np.log((ones + prior) / (zeros + prior)), -10, 10).astype(np.float16)
        self.gate = np.minimum(np.ceil(np.log2(seen + 1)) / 2, GATES - 1).astype(np.int8)
        self.weights = np.full((K, GATES), 1.0 / K, np.float32)

    @cached_property
    def plain(self) -> np.ndarray:
        """Logits as they are looked up; only the shorter form is sent around."""
        return self.logit.astype(np.float32)

    @cached_property
    def weighted(self) -> np.ndarray:
        """Logits times the weights of their gates; the weights must not change any more."""
        return np.concatenate([self.weights[k][self.gate[lo:hi]] * self.plain[lo:hi] for k, (lo, hi) in enumerate(zip(STARTS[:-1], STARTS[1:], strict=True))])

    def inputs(self, slots) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty((len(slots), len(slots[0])), np.float32)
        gate = np.empty(x.shape, np.int8)
        for k, s in enumerate(slots):
            np.take(self.plain, s, out=x[k], mode="clip")
            np.take(self.gate, s, out=gate[k], mode="clip")
        return x, gate

    def score(self, t: Tokens, v: Vocabulary) -> np.ndarray:
        """Natural log probability of each text's symbols."""
        total, extra = np.zeros(t.n), np.zeros((K, t.n), np.float32)
        held = None
        for begin in range(0, len(t.word), CHUNK):
            token, bit, slots = t.bits(v, begin)
            x, z = np.empty((K, len(bit)), np.float32), np.zeros(len(bit), np.float32)
            for k, s in enumerate(slots):
                np.take(self.plain, s, out=x[k], mode="clip")
                z += np.take(self.weighted, s)
            part = [x, z, 2 * bit - 1, t.owner[token]]
            if held is not None:
                part = [np.concatenate(both, axis=-1) for both in zip(held, part, strict=True)]
            held = None
            doc = part[3]
            if not len(doc):
                continue
            first = np.searchsorted(doc, np.arange(t.n + 1))
            if begin + CHUNK < len(t.word) and t.owner[begin + CHUNK] == doc[-1]:
                # A text that goes on keeps its last block for the next round.
                whole = len(doc) - (len(doc) - first[doc[-1]]) % BLOCK_BITS
                held = [y[..., whole:] for y in part]
                part = [y[..., :whole] for y in part]
            self._refined(*part, first, extra, total)
        return total

    def _refined(self, x, z, sign, doc, first, extra, total) -> None:
        """Add the log probabilities of whole blocks to ``total``, block by block, and refine ``extra``."""
        if not len(doc):
            return
        block = (np.arange(len(doc)) - first[doc]) // BLOCK_BITS
        order = np.argsort(block.astype(np.uint16) if block.max() < 1 << 16 else block, kind="stable")
        x, z, sign, doc, block = x[:, order], z[order], sign[order], doc[order], block[order]
        at = np.searchsorted(block, np.arange(block[-1] + 2))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            d, xs, s = doc[lo:hi], x[:, lo:hi], sign[lo:hi]
            edge = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            whose, length = d[edge], np.diff(np.append(edge, len(d)))
            logit = z[lo:hi].copy()
            for k in range(K):
                logit += np.repeat(extra[k, whose], length) * xs[k]
            odds = np.exp(np.minimum(-s * logit, 80))  # against the bit that came
            total[whose] -= np.add.reduceat(np.log1p(odds).astype(np.float64), edge)
            error = s * (odds / (1 + odds))
            for k in range(K):
                extra[k, whose] += np.float32(RATE / 16) * np.add.reduceat(error * xs[k], edge)


class Gates:
    """Gate weights that follow the coding length of the bits read so far, by RMS-scaled gradient steps."""

    def __init__(self):
        self.weights = np.full((K, GATES), 1.0 / K)
        self.scale = np.zeros((K, GATES))
        self.seen = np.zeros((K, GATES), np.int64)
        self.steps = 0

    def read(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        """Learn from some bits; the first ones are read again until there were ``STEPS`` steps."""
        if not len(bit):
            return
        gate = [g.astype(np.intp) for g in gate]
        self.seen += np.stack([np.bincount(g, minlength=GATES) for g in gate])
        parts = -(-len(bit) // STEP_BITS)
        for _ in range(max(1, -(-(STEPS - self.steps) // parts))):
            for lo in range(0, len(bit), STEP_BITS):
                self._step(x[:, lo : lo + STEP_BITS], [g[lo : lo + STEP_BITS] for g in gate], bit[lo : lo + STEP_BITS])

    def _step(self, x, gate, bit):
        z = np.zeros(len(bit), np.float32)
        for k in range(K):
            z += self.weights[k].astype(np.float32)[gate[k]] * x[k]
        error = bit - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.stack([np.bincount(gate[k], error * x[k], GATES) for k in range(K)]) / len(bit)
        self.scale = 0.9 * self.scale + 0.1 * g**2
        self.weights += 0.1 / (1 + self.steps / 10) * g / (np.sqrt(self.scale) + 1e-6)
        self.steps += 1


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over the texts."""

    def run(batches):
        for b in batches:
            data, offsets = bt.flat(b["text"])
            code, _, _, _ = bt.word_hashes(bt.LOWER[data], offsets)
            word, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "c"])

    return texts.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words with the highest counts, ``most`` at most; words of equal class come together or not at all."""
    kind = F.floor(F.log2("c") * 8)
    classes = sorted(((r.k, r.n) for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in classes:
        if total + n > most:
            break
        total, least = total + n, k
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = counts.filter(kind >= least).toArrow()
    return rows["word"].to_numpy().view(np.uint64), rows["c"].to_numpy()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary, Model]:
    """(counts, vocabulary, model) of the training documents ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = cut(count_words(texts))
    release(spark)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_docs = texts.count()
    v = Vocabulary(*_head(counts, HEAD), n_docs, sums.n or 0, sums.v)

    texts = texts.select("text", F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(2)).alias("half"))
    words = spark.sparkContext.broadcast(v)
    size, per_half = int(STARTS[-1]), int(STARTS[-1]) // TABLE_BLOCK

    def slices(batches):
        """(bits, slots, which half) of a few texts at a time."""
        for b in batches:
            data, offsets = bt.flat(b["text"])
            half = b["half"].to_numpy()
            for i, j in bt.slices(offsets, SLICE):
                t = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words.value)
                for first in range(0, len(t.word), CHUNK):
                    token, bit, slots = t.bits(words.value, first)
                    yield bit, slots, half[i:j][t.owner[token]]

    def tables(batches):
        counts = np.zeros(4 * size, np.int64)  # by half; zeros and ones of a slot stand side by side
        for bit, slots, half in slices(batches):
            side = 2 * size * half + bit.astype(np.int64)
            for s in slots:
                np.add.at(counts, side + 2 * s, 1)
        pairs = counts.reshape(2 * per_half, TABLE_BLOCK, 2)
        for block in np.flatnonzero(pairs.any(axis=(1, 2))).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([_packed(pairs[block, :, k])]) for k in (0, 1)]], names=["block", "zeros", "ones"])

    def summed(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, z, o in zip(b["block"].to_pylist(), b["zeros"].to_pylist(), b["ones"].to_pylist(), strict=True):
                s = held.setdefault(k, [0, 0])
                for side, x in enumerate((z, o)):
                    s[side] = s[side] + np.frombuffer(x, f"<u{len(x) // TABLE_BLOCK}").astype(np.int64)
        for k, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x.astype("<f4").tobytes()]) for x in s]], names=["block", "zeros", "ones"])

    kind = "block int, zeros binary, ones binary"
    blocks = texts.mapInArrow(tables, kind).repartition("block").mapInArrow(summed, kind)
    zeros, ones = np.zeros(2 * size, np.float32), np.zeros(2 * size, np.float32)
    for block, z, o in zip(*blocks.toArrow().columns, strict=True):  # four numbers per slot, whatever the corpus
        at = block.as_py() * TABLE_BLOCK
        zeros[at : at + TABLE_BLOCK] = np.frombuffer(z.as_buffer(), "<f4")
        ones[at : at + TABLE_BLOCK] = np.frombuffer(o.as_buffer(), "<f4")
    model = Model(zeros[:size] + zeros[size:], ones[:size] + ones[size:])
    halves = spark.sparkContext.broadcast(Model(zeros, ones))
    del zeros, ones
    release(spark)

    def online(batches):
        gates = Gates()
        for bit, slots, half in slices(batches):
            other = size * (1 - half)
            x, gate = halves.value.inputs([s + other for s in slots])
            gates.read(x, gate, bit)
        n = gates.seen.ravel()
        # Whole millionths, so that the sum does not depend on its order.
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(K * GATES, dtype=np.int32)), pa.array(n), pa.array(np.round(gates.weights.ravel() * 1e6).astype(np.int64) * n)], names=["cell", "n", "weight"])

    reached = texts.mapInArrow(online, "cell int, n long, weight long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("weight").cast("decimal(28,0)")).alias("weight"))
    for r in reached.collect():
        if r.n:
            model.weights[r.cell // GATES, r.cell % GATES] = float(r.weight) / r.n / 1e6
    return counts, v, model


def _packed(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest one."""
    most = int(x.max())
    return x.astype(next(f"<u{k}" for k in (1, 2, 4, 8) if most < 1 << 8 * k)).tobytes()


def score_documents(docs: DataFrame, held_out, counts: DataFrame, v: Vocabulary, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every document."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((v, model))

    def run(batches):
        v, model = shared.value
        for b in batches:
            data, offsets = bt.flat(b["text"])
            for i, j in bt.slices(offsets, SLICE):
                t = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], v)
                known = t.index >= 0
                count = np.zeros(len(t.word))
                count[known] = v.counts[t.index[known]]
                count[t.is_end] = v.docs
                add = lambda x, n=t.n, o=t.owner: np.bincount(o, x, n)
                length = np.diff(t.first)
                base = add(np.log10(count + 1)) - length * v.base_log
                tail = t.symbol == v.escape
                score = base if not v.docs else model.score(t, v) / LOG10 + add(np.where(tail, np.log10(count + 1) - v.tail_log, 0))
                far = np.flatnonzero(~known & ~t.is_end)
                key = bt.mix(t.word[far] + t.owner[far].astype(np.uint64) * bt.BASE)
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                order = np.argsort(far[first], kind="stable")
                far, n = far[first][order], n[order]
                at = np.searchsorted(t.owner[far], np.arange(t.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(i, j - i), b["held_out"].slice(i, j - i), pa.array(length), pa.array(add(known | (t.is_end & (v.docs > 0))).astype(np.int64)), pa.array(base), pa.array(score), pa.array(np.diff(offsets[i : j + 1])), bt.list_column(t.word[far].view(np.int64), at, pa.int64()), bt.list_column(n.astype(np.int32), at, pa.int32())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bytes", "far", "times"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long, far array<long>, times array<int>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    # Words beyond the broadcast head: their counts are joined.
    far = rows.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("word"), F.col("x.times").alias("times"))
    more = far.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log"), F.sum("times").alias("known"))
    out = rows.drop("far", "times").join(more, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    score = F.col("score") + log
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        score.alias("score"),
        F.when(F.col("bytes") > 0, -score * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )


def score_split(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all."""
    out = fold(F.col("doc_id"), folds) == held_out
    counts, v, model = learn(docs.filter(~out))
    return score_documents(docs, out, counts, v, model)
