"""MinHash near-dedup with an LSH forest.

Every document has a MinHash signature of its set of word shingles. The forest keeps
several orders of the signatures: each tree sorts all documents by its own sequence of
signature values. Documents that share the first ``MIN_DEPTH`` values are a region. All
documents of a small region are candidates of each other. In a crowded one, the next ones in
the order, which have the longest common prefixes, come first (adaptive depth).

Documents with equal sets are one class first, so copies cost nothing more. Candidates are
confirmed on the full sets: first one candidate per document, which joins most of a group,
then every candidate whose ends are still in different components. In a crowded region that
then has several components, all documents of different components are compared on their
full sets, block by block as products of matrices; two blocks give no more links than join
their components. The sets are built from the text again, only for documents that have a
candidate.

Recall: at similarity 0.8 two documents share three values in a tree with probability 0.51,
so 16 trees miss a pair with probability 1e-5.

Defined cases: null and empty texts have an empty set and are linked with nothing; a text
with fewer than ``size`` words has its whole sequence as its one shingle; equal rows share a
component; rows that share an id and differ in text are linked by their own texts; a null
doc_id is its own row with a null component and is kept; an empty table gives an empty
result; only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as bt
from .cluster import copies, cut, prepare, release, together
from .graph import components, merged
from .neighbours import exploded, sorted_neighbours

VALUES, TREES, DEPTH, MIN_DEPTH = 64, 16, 10, 3
#: Documents and bytes of sets of a block, and shingles that are looked at together.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 1 << 23, 1 << 12
_rng = np.random.default_rng(77)
MULTIPLY = (_rng.integers(0, 1 << 62, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
ORDERS = np.stack([_rng.permutation(VALUES)[:DEPTH] for _ in range(TREES)])
PLACE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (lower-cased A-Z, words between blanks)."""
    code, owner, _, _ = bt.word_hashes(bt.LOWER[data], offsets)
    n = len(offsets) - 1
    first = bt.bounds(owner, n)
    if len(code) >= size:
        m = len(code) - size + 1
        gram = np.zeros(m, np.uint64)
        for k in range(size):
            gram += bt.mix(code[k : k + m] + PLACE[k])* PLACE[k]
        gram = bt.mix(gram)
    else:
        gram = np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(gram[lo : hi - size + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for c in code[lo:hi]:
                whole = bt.mix(np.array([whole]) * PLACE[0] + c)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """VALUES minima of 32 bits."""
    best = np.full(VALUES, (1 << 32) - 1, np.uint32)
    for k in range(0, len(values), 2048):
        x = values[k : k + 2048, None] * MULTIPLY + ADD
        best = np.minimum(best, (x >> np.uint64(32)).min(0).astype(np.uint32))
    return best


def _signed(size: int):
    def run(batches):
        for b in batches:
            data, offsets = bt.flat(b["text"])
            n, key, sig = [], [], []
            for i, j in bt.slices(offsets):
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size):
                    n.append(len(s))
                    a, c = bt.mix(s + np.uint64(1)).sum(dtype=np.uint64), bt.mix(s ^ PLACE[7]).sum(dtype=np.uint64)
                    key.append(int(a).to_bytes(8, "big") + int(c).to_bytes(8, "big") + len(s).to_bytes(4, "big"))
                    sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "row", "n_shingles", "key", "sig"])

    return run


def _sets(size: int):
    def run(batches):
        for b in batches:
            data, offsets = bt.flat(b["text"])
            sets = [s.tobytes() for i, j in bt.slices(offsets) for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(sets, pa.binary())], names=["node", "members"])

    return run


def _tree_keys(batch):
    sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, VALUES, 4)
    keys = np.empty((TREES, len(sig), 1 + 4 * DEPTH), np.uint8)
    for t in range(TREES):
        keys[t, :, 0] = t
        keys[t, :, 1:] = sig[:, ORDERS[t]].reshape(len(sig), -1)
    return keys


def _confirmer(share: int, names: list[str]):
    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b["left"], b["right"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short = min(len(p), len(q))
                common = 0
                if 100 * short >= share * max(len(p), len(q)):
                    place = np.minimum(np.searchsorted(p, q), len(p) - 1)
                    common = int((p[place] == q).sum())
                good.append(100 * common >= share * (len(p) + len(q) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b[c].filter(mask) for c in names], names=names)

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    prepare(pairs.sparkSession, 200)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("right")), "b")
    kept = [f"{c} long" for c in pairs.columns]
    return cut(both.select(*pairs.columns, "left", "right").mapInArrow(_confirmer(share, pairs.columns), ", ".join(kept)))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all left sets with all right ones, by products of 0-1 matrices."""
    x, y = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(columns):
        return out

    def places(values, sets):
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        known = columns[at] == values
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known]
        order = np.argsort(at[known], kind="stable")
        return at[known][order], row[order]

    (xc, xr), (yc, yr) = places(x, left), places(y, right)
    for lo in range(0, len(columns), COLUMNS):
        hi = min(lo + COLUMNS, len(columns))
        parts = []
        for c, r, n in ((xc, xr, len(left)), (yc, yr, len(right))):
            i, j = np.searchsorted(c, [lo, hi])
            m = np.zeros((n, hi - lo), np.float32)
            m[r[i:j], c[i:j] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs (number, least number reached) of the components of the edges (a, b)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    moved = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[moved], names[label[moved]]], 1)


def _blocks_met(share: int):
    """From rows sorted by region, lo, hi: two blocks of a region, or one: links (ca, cb) that join the
    components which documents of both link, on their full sets.
    """

    def emit(rows):
        group, sets, k, lo, hi = rows
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(k == lo), np.flatnonzero(k == hi)
        kinds, count = np.unique(group, return_counts=True)
        main = group == kinds[count.argmax()]
        found = [np.zeros((0, 2), np.int64)]
        # Most are of one component, whose pairs among themselves need no look.
        for x, y in ((left[~main[left]], right), (left[main[left]], right[~main[right]])):
            if len(x) and len(y):
                common = _common([sets[i] for i in x], [sets[i] for i in y]).astype(np.int64)
                i, j = np.nonzero(100 * common >= share * (size[x][:, None] + size[y] - common))
                found.append(np.stack([group[x[i]], group[y[j]]], 1))
        found = np.concatenate(found)
        return _spanning(found[:, 0], found[:, 1])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            sets = np.empty(b.num_rows, object)
            sets[:] = [np.frombuffer(x.as_buffer(), np.uint64) for x in b["members"]]
            new = [b["region"].to_numpy(), b["c"].to_numpy(), sets, *[b[c].to_numpy() for c in ("k", "lo", "hi")]]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            region, lo, hi = held[0], held[4], held[5]
            at, out = 0, []
            for end in (np.flatnonzero((region[1:] != region[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist():
                out.append(emit([x[at:end] for x in held[1:]]))
                at = end
            held = [x[at:] for x in held]
            if out:
                yield pairs_of(np.concatenate(out))
        if held is not None:
            yield pairs_of(emit(held[1:]))

    def pairs_of(found):
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["ca", "cb"])

    return run


def _crowd_links(crowd: DataFrame, sets: DataFrame, reached: DataFrame, share: int) -> DataFrame:
    """Links (ca, cb) between the components so far of documents of one crowded region (region, id)."""
    rows = crowd.join(sets.select(F.col("node").alias("id"), F.length("members").alias("bytes")), "id").join(reached.select(F.col("node").alias("id"), "component"), "id", "left")
    rows = cut(rows.select("region", "id", "bytes", F.coalesce("component", "id").alias("c")))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    mixed = rows.groupBy("region").agg(F.min("c").alias("least"), F.max("c").alias("most"), blocks.alias("blocks")).filter("least < most").select("region", "blocks")
    rows = rows.join(cut(mixed), "region").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(sets.select(F.col("node").alias("id"), "members"), "id").select("region", "c", "members", "k", F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi"))
    prepare(rows.sparkSession, 200)
    return cut(together(rows, "region", "lo", "hi").mapInArrow(_blocks_met(share), "ca long, cb long").distinct())


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, best) of every row; row: hash of the text, best: (doc_id, row) of the one that stays."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    signed = cut(texts.mapInArrow(_signed(size), "doc_id long, row long, n_shingles long, key binary, sig binary"))

    # One node for each set, with its least document; sets of one document and of many alike.
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.first("sig").alias("sig"))
    classes = cut(classes.select(F.xxhash64("key").alias("node"), "key", "best", "sig"))
    prepare(spark, 10_000)
    met = cut(sorted_neighbours(exploded(classes.select(F.col("node").alias("id"), "sig"), _tree_keys), prefix=1 + 4 * MIN_DEPTH))
    pairs = cut(met.filter("b is not null").select("a", "b").distinct())
    crowd = cut(met.filter("b is null").select(F.xxhash64("region").alias("region"), F.col("a").alias("id")))
    release(spark)

    touched = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("id")).distinct()
    prepare(spark)
    wanted = classes.join(touched, "node", "left_semi").select("node", F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row"))
    sets = cut(texts.join(wanted, ["doc_id", "row"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(_sets(size), "node long, members binary"))
    release(spark)

    prepare(spark, 2000)
    reached = components(_confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent))
    rest = pairs.join(reached.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(reached.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    rest = cut(rest.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca != cb"))
    release(spark)
    reached = merged(reached, _confirmed(rest, sets, percent))
    # Two regions of each document join most of what is left; then all regions that still have several components.
    lead = crowd.groupBy("id").agg(F.min("region").alias("x"), F.max("region").alias("y"))
    for some in (crowd.join(lead, "id").filter("region = x or region = y").select("region", "id"), crowd):
        links = _crowd_links(some, sets, reached, percent)
        release(spark)
        if not links.isEmpty():
            reached = merged(reached, links)

    named = classes.select("node", "key", "best").join(reached, "node", "left").select("key", "best", F.coalesce("component", "node").alias("component"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("best").alias("best"))
    prepare(spark)
    out = signed.drop("sig").join(cut(named.select("key", "component").join(least, "component").select("key", "best")), "key", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    best = F.when(linked, F.col("best")).otherwise(F.struct("doc_id", "row"))
    return out.select("doc_id", "row", "n_shingles", best.alias("best"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked at ``percent`` of Jaccard similarity or more; component_id is the
    smallest id that links reach.
    """
    out = _grouped(docs, size, percent, id_col, text_col)
    return out.select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("best.doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, with their columns; of equal rows one stays."""
    kept = _grouped(docs, size, percent, "doc_id", "text").filter("best.doc_id <=> doc_id and best.row = row").select(F.col("doc_id").alias("_id"), F.col("row").alias("_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.join(cut(kept), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    once, _ = copies(docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")), rows, ["id", "hash"])
    return once.select("row.*")
