"""Token counts by a separator scan over flat token files.

A flat token file is a sequence of fixed-width token ids without an index; a separator id
ends each document. Files come as fixed-size blocks. Every block is searched for separators
by one vectorised comparison and leaves a summary: how many separators, where the last one
is, and the lengths of the documents that lie inside it. A prefix scan over the summaries
(first within groups of blocks, then over the groups) gives each block the number of
documents before it and the place of the last separator before it, which stitches the
documents that cross block boundaries.

Defined cases: a document without tokens has length 0; tokens after the last separator of a
file are one more document, not terminated; empty files have no document; null texts have
no tokens; texts never contain the separator, since special tokens are not recognised in
them; repeated rows are separate documents.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytestext as bt
from .cluster import cut, prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public byte-level BPE word pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 1 << 18
GROUP = 4096
#: A run of this many blanks is encoded on its own, since the pattern's way back over a very long one overflows the stack.
LONG_BLANK = 1 << 12


def load_encoder(data: bytes, pattern: str = PATTERN):
    """A tiktoken encoding of a vocabulary file's content, and the first id that is free."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


#: The pattern's blanks; Python's own class has four more.
_LONG = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANK},}}")


def encode(encoder, text: str) -> np.ndarray:
    """The tokens of the whole text; a long run of blanks is cut where PATTERN ends a match."""
    parts, at = [], 0
    for m in _LONG.finditer(text):
        end = m.end() - (m.end() < len(text))  # the last blank goes with what follows
        parts += [encoder.encode_ordinary(text[at : m.start()]), encoder._encode_single_piece(text[m.start() : end])]
        at = end
    parts.append(encoder.encode_ordinary(text[at:]))
    return np.concatenate([np.asarray(p, np.uint32) for p in parts])


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, int, int]:
    """Flat token files of the documents, one per partition, the separator's id, and the bytes of an id.

    Rows: file, block, data (token ids, little-endian; null in rows of ids),
    first and ids (the documents of a file in order, beginning with number ``first``).
    """
    spark = docs.sparkSession
    prepare(spark, 500)
    with open(vocabulary, "rb") as f:  # on the driver; its content goes to the workers
        content = f.read()
    _, separator = load_encoder(content, pattern)
    width = 2 if separator < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(content)

    def run(batches):
        encoder, _ = load_encoder(shared.value, pattern)
        file = TaskContext.get().partitionId()
        held, size, block, seen = [], 0, 0, 0
        end = np.array([separator], np.uint32)

        def rows(block, data, first, ids):
            n = max(len(data), len(ids))
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int32()), pa.array([block + k for k in range(n)], pa.int64()), pa.array(data or [None] * n, pa.binary()), pa.array([first] * n, pa.int64()), pa.array(ids or [None] * n, pa.list_(pa.int64()))], names=["file", "block", "data", "first", "ids"])

        for b in batches:
            for text in b["text"].to_pylist():
                if text:
                    held.append(encode(encoder, text))
                    size += len(held[-1])
                held.append(end)
                size += 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    whole = size // block_tokens
                    yield rows(block, [flat[k * block_tokens : (k + 1) * block_tokens].astype(f"<u{width}").tobytes() for k in range(whole)], 0, [])
                    held, size, block = [flat[whole * block_tokens :]], size - whole * block_tokens, block + whole
            if b.num_rows:
                yield rows(0, [], seen, [b["doc_id"].to_pylist()])
                seen += b.num_rows
        if size:
            yield rows(block, [np.concatenate(held).astype(f"<u{width}").tobytes()], 0, [])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "file int, block long, data binary, first long, ids array<long>"), separator, width


def read_token_files(spark: SparkSession, path: str, width: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of the flat files under ``path``; a file is read by one task and may have up to 2 GB."""
    prepare(spark, 1)

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                data = content.as_buffer()
                step = block_tokens * width
                for k in range(0, len(data) // width * width, step):
                    part = data.slice(k, min(step, len(data) // width * width - k)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // step], pa.int64()), pa.array([part])], names=["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, data binary")


def document_lengths(blocks: DataFrame, separator: int, block_tokens: int = BLOCK_TOKENS, width: int = 4) -> DataFrame:
    """(file, ordinal, n_tokens, terminated) from the blocks (file, block, data) of flat token files with ``width`` bytes an id."""
    prepare(blocks.sparkSession, 16)

    def run(batches):
        for b in batches:
            size, count, head, last, inner = [], [], [], [], []
            for data in b["data"]:
                tokens = np.frombuffer(data.as_buffer(), f"<u{width}")
                at = np.flatnonzero(tokens == separator)
                size.append(len(tokens))
                count.append(len(at))
                head.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            lengths = bt.list_column(np.concatenate(inner) if inner else np.zeros(0, np.int64), np.cumsum([0, *map(len, inner)]), pa.int64())
            yield pa.RecordBatch.from_arrays([b["file"], b["block"], *[pa.array(x, pa.int64()) for x in (size, count, head, last)], lengths], names=["file", "block", "size", "count", "head", "last", "inner"])

    kind = dict(blocks.dtypes)["file"]
    found = cut(blocks.select("file", "block", "data").mapInArrow(run, f"file {kind}, block long, size long, count long, head long, last long, inner array<long>"))
    start = F.col("block") * block_tokens
    found = found.select("*", start.alias("start"), F.floor(F.col("block") / GROUP).alias("group"), (start + F.col("last")).alias("sep"))
    # Exclusive prefix scans: the number of separators and the place of the last one before a group, then before a block.
    groups = found.groupBy("file", "group").agg(F.sum("count").alias("n"), F.max("sep").alias("sep"), F.max("block").alias("top"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.max("sep").over(before).alias("sep0"), F.max("top").over(Window.partitionBy("file")).alias("top"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("n1", F.coalesce(F.sum("count").over(inside), F.lit(0))).withColumn("sep1", F.max("sep").over(inside)).join(groups, ["file", "group"])
    base = F.col("n0") + F.col("n1")
    begin = F.coalesce(F.greatest("sep0", "sep1") + 1, F.lit(0))
    stitched = F.when(F.col("count") > 0, F.concat(F.array(F.col("start") + F.col("head") - begin), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("count") > 0, F.col("size") - 1 - F.col("last")).otherwise(F.col("start") + F.col("size") - begin)
    out = found.select("file", base.alias("base"), (base + F.col("count")).alias("next"), stitched.alias("lengths"), F.when((F.col("block") == F.col("top")) & (rest > 0), rest).alias("rest"))
    ended = out.select("file", "base", F.posexplode("lengths").alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    return ended.unionByName(out.filter("rest is not null").select("file", F.col("next").alias("ordinal"), F.col("rest").alias("n_tokens"), F.lit(False).alias("terminated")))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens for every document: flat files are written, then scanned."""
    flat, separator, width = tokenise(docs, vocabulary, pattern, block_tokens=block_tokens)
    flat = cut(flat)
    lengths = document_lengths(flat.filter("data is not null"), separator, block_tokens, width)
    names = flat.filter("ids is not null").select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(lengths, ["file", "ordinal"], "left").select("doc_id", "n_tokens")
