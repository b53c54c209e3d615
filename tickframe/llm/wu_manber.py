"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are symbols (64-bit codes). Every window of ``window`` words of a benchmark item is a
pattern, an item with fewer words is one pattern of its own length. For each pattern length
a shift table over blocks of two words says how far a search position can move; where it
says 0, the suffix block selects the patterns to compare, and all words are compared. Many
search positions advance together as lanes of one array.

The benchmark is read in blocks of ``block_items`` items: only one block's tables are sent
to the workers at a time, and each block searches all documents.

Defined cases: null texts have no words; an empty benchmark hits nothing; items without a
word never occur; repeated items and repeated documents count by row for documents and by
id for items; items with a null id hit words but are not listed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as bt
from .cluster import prepare

MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
SPANS = "array<struct<start:int,end:int>>"


class Patterns:
    """Shift and suffix tables for the patterns of one length."""

    def __init__(self, words: np.ndarray, items: np.ndarray, bits: int = 18):
        self.length = words.shape[1]
        self.words, inverse = np.unique(words, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.items, self.item_at = items[order], np.searchsorted(inverse.ravel()[order], np.arange(len(self.words) + 1))
        self.block = min(2, self.length)
        self.bits = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.length - self.block + 1, dtype=np.int64)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._code(self.words, end) >> self.bits, self.length - 1 - end)
        suffix = self._code(self.words, self.length - 1)
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.by_suffix]

    def _code(self, words: np.ndarray, end) -> np.ndarray:
        last = words[..., end]
        return bt.mix(last * MULT[0] + words[..., end - 1] * MULT[1] if self.block == 2 else last * MULT[0])

    def search(self, text: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of every occurrence."""
        n = len(text) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = -(-n // min(lanes, n))
        at = np.arange(0, n, width, dtype=np.int64)
        stop = np.minimum(at + width, n)
        found = []
        while len(at):
            code = self._code(text, at + self.length - 1)
            move = self.shift[code >> self.bits]
            if (zero := move == 0).any():
                found.append(at[zero])
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        code = self._code(text, at + self.length - 1)
        lo, hi = np.searchsorted(self.suffix, code, "left"), np.searchsorted(self.suffix, code, "right")
        count = hi - lo
        at = np.repeat(at, count)
        which = self.by_suffix[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        for k in range(self.length - 1, -1, -1):
            same = text[at + k] == self.words[which, k]
            at, which = at[same], which[same]
        return at, which


def compile_patterns(texts: list[bytes], window: int) -> list[Patterns]:
    """Tables of one block of items; an item's place in ``texts`` is its number."""
    at = np.cumsum([0, *map(len, texts)])
    data = bt.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    code, owner, _, _ = bt.word_hashes(data, at, bt.ALNUM)
    first = bt.bounds(owner, len(texts))
    by_length: dict[int, tuple[list, list]] = {}
    for k in range(len(texts)):
        words = code[first[k] : first[k + 1]]
        if not len(words):
            continue
        size = min(window, len(words))
        rows, items = by_length.setdefault(size, ([], []))
        view = np.lib.stride_tricks.sliding_window_view(words, size)
        rows.append(view)
        items.append(np.full(len(view), k))
    return [Patterns(np.concatenate(rows), np.concatenate(items)) for _, (rows, items) in sorted(by_length.items())]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones, sorted."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _searcher(shared, window: int):
    """An Arrow function that adds one block's hits to the columns n_words, spans and items."""

    def run(batches):
        patterns, names = shared.value
        for batch in batches:
            data, offsets = bt.flat(batch["text"])
            data = bt.LOWER[data]
            code, owner, _, _ = bt.word_hashes(data, offsets, bt.ALNUM)
            n = len(offsets) - 1
            first = bt.bounds(owner, n)
            # A symbol of no pattern stands between two documents.
            text = np.zeros(len(code) + n, dtype=np.uint64)
            place = np.arange(len(code)) + owner
            text[place] = code
            starts, ends, docs, items = [], [], [], []
            for p in patterns:
                at, which = p.search(text)
                doc = np.searchsorted(first + np.arange(n + 1), at, "right") - 1
                inside = at - first[doc] - doc
                starts.append(doc * (1 << 40) + inside)
                ends.append(doc * (1 << 40) + inside + p.length)
                count = p.item_at[which + 1] - p.item_at[which]
                docs.append(np.repeat(doc, count))
                items.append(p.items[np.repeat(p.item_at[which] - np.cumsum(count) + count, count) + np.arange(count.sum())])
            spans, listed = batch["spans"].to_pylist(), batch["items"].to_pylist()
            if starts and sum(map(len, starts)):
                s, e = merged(np.concatenate(starts), np.concatenate(ends))
                for d, lo, hi in zip((s >> 40).tolist(), (s & ((1 << 40) - 1)).tolist(), (e & ((1 << 40) - 1)).tolist(), strict=True):
                    spans[d] = [*spans[d], {"start": lo, "end": hi}]
                pairs = np.unique(np.concatenate(docs) * len(names) + np.concatenate(items))
                for pair in pairs.tolist():
                    if (name := names[pair % len(names)]) is not None:
                        listed[pair // len(names)] = [*listed[pair // len(names)], name]
                for d in np.unique(s >> 40).tolist():
                    lo, hi = merged(np.array([x["start"] for x in spans[d]]), np.array([x["end"] for x in spans[d]]))
                    spans[d] = [{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            schema = batch.schema
            new = {"n_words": pa.array(np.diff(first), pa.int64()), "spans": pa.array(spans, schema.field("spans").type), "items": pa.array(listed, schema.field("items").type)}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch[f.name]) for f in schema], schema=schema)

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_items: int = 5000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, n_words, spans, items): each row of ``docs`` as a struct, the word ranges hit (disjoint) and the item ids (sorted strings)."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    rows = benchmark.select(F.col(item_col).cast("string"), F.coalesce(F.col(item_text_col), F.lit(""))).toLocalIterator()
    first = True
    while (block := list(itertools.islice(rows, block_items))) or first:
        first = False
        shared = spark.sparkContext.broadcast((compile_patterns([t.encode() for _, t in block], window), [i for i, _ in block] or [None]))
        out = out.mapInArrow(_searcher(shared, window), out.schema)
    return out.select("row", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def _hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window)
    return found.select("row.doc_id", "n_words", _hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_hit: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most the share ``most_hit`` is hit, with their columns."""
    found = find_benchmark(docs, benchmark.select("item_id", "text"), window)
    return found.filter(_hit_words() <= most_hit * F.col("n_words")).select("row.*")
