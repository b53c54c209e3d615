"""Repeated passages: a run-length index over the places where long matches can be.

Every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere is removed.

1. Anchors. Each window of LENGTH bytes chooses the smallest hash among its ``GRAM``-byte
   strings, the leftmost of equal ones. Equal windows choose the same string at the same
   place, so a repeat is found among anchors with equal strings. The windows of one anchor
   are consecutive; the bytes they cover are its region, and every window lies in one region.
2. Equal regions of equal anchors are one class, counted with map-side combine. A class of
   two or more is a repeat from end to end, however many copies there are.
3. Anchors with several classes go to the index: the bytes of one region per class are
   fetched, all classes of an anchor come together in one block, and each block is indexed:
   suffix order, Burrows-Wheeler transform, its runs, and the common prefix lengths at run
   ends; the others follow from those while streaming over the text (a suffix inside a run
   matches one byte less than the suffix before it). The matching statistics of a region
   then tell which windows occur in another one.
4. A crowded anchor (over ``CROWD`` classes) is divided before step 3: its windows are split
   into cells by their distance to the anchor, and each cell is keyed by the bytes that all
   its windows share; cells that are still crowded are split further, down to one window.

Defined cases: null texts are empty; texts shorter than LENGTH lose nothing; repeated rows
are repeats of each other; an empty table gives an empty result; ids may be null or
repeated (rows are told apart by a 64-bit hash of id and text); only doc_id and text are
read, by byte, so a removal may cut a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as bt
from .cluster import cut, prepare, release, together

LENGTH, GRAM = 200, 16
REACH = LENGTH - GRAM + 1
PIECE = 1 << 19
CROWD = 5000
#: Up to so many crowded anchors (8 bytes each) are broadcast.
FEW = 1 << 16
#: A crowded anchor's windows are divided into 2 ** level cells; in the last step a cell is one window.
LEVELS = (3, 6, 8)
BLOCK = 56_000
SEPARATOR = 0xFF
MIX_A, MIX_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(text, start, length, place, gram hash, region hash) of every region; place: anchor minus start."""
    parts = []
    for i, j in bt.slices(offsets, PIECE):
        lo = int(offsets[i])
        while True:
            hi = min(int(offsets[j]), lo + PIECE + LENGTH - 1) if j - i == 1 else int(offsets[j])
            seg, at = data[lo:hi], np.clip(offsets[i : j + 1] - lo, 0, hi - lo)
            n = len(seg) - LENGTH + 1
            if n > 0:
                up, down = bt.powers(len(seg) + 1)
                sums = np.zeros(len(seg) + 1, np.uint64)
                np.cumsum(bt.BYTE_CODE[seg] * up[: len(seg)], out=sums[1:])
                gram = bt.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(seg) - GRAM + 1])
                mask = np.uint64((1 << 20) - 1)
                keyed = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
                rows = np.full(-(-len(keyed) // REACH) * REACH, ~np.uint64(0))
                rows[: len(keyed)] = keyed
                rows = rows.reshape(-1, REACH)
                ahead = np.minimum.accumulate(rows, axis=1).ravel()
                back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
                place = (np.minimum(back[:n], ahead[REACH - 1 : REACH - 1 + n]) & mask).astype(np.int64)
                valid = np.zeros(n + 1, np.int64)
                some = np.diff(at) >= LENGTH
                np.add.at(valid, at[:-1][some], 1)
                np.add.at(valid, at[1:][some] - LENGTH + 1, -1)
                valid = np.cumsum(valid[:-1]) > 0
                new = valid.copy()
                new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
                begin = np.zeros(n + 1, bool)
                begin[at[:-1][some]] = True
                new |= begin[:n] & valid
                first = np.flatnonzero(new)
                close = np.append(first[1:], n)
                ends = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
                close = np.minimum(close, ends[np.searchsorted(ends, first, "right")])
                stop = close - 1 + LENGTH
                whole = bt.mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64) * MIX_A + (place[first] - first).astype(np.uint64) * MIX_B)
                text = np.searchsorted(at, first, "right") - 1 + i
                parts.append((text, first + lo - offsets[text], stop - first, place[first] - first, gram[place[first]], whole))
            if hi >= int(offsets[j]):
                break
            lo += PIECE
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchor_rows(batches):
    for b in batches:
        data, offsets = bt.flat(b["text"])
        text, start, length, place, gram, whole = anchors(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), b["key"].take(pa.array(text)), pa.array(start, pa.int32()), pa.array(length.astype(np.int32)), pa.array(place.astype(np.int32))], names=["fp", "ctx", "key", "start", "length", "place"])


class RunIndex:
    """Suffix order of a text, its run-compressed Burrows-Wheeler transform and matches between suffixes."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.eight = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
        self.order = self._suffixes(text)
        bwt = text[self.order - 1].astype(np.int16)
        bwt[self.order == 0] = -1  # nothing precedes the first suffix: a run of its own
        ends = np.ones(n, bool)
        ends[1:] = bwt[1:] != bwt[:-1]
        # The transform by runs: symbol, where it starts, and the suffix at its head.
        self.run_at = np.flatnonzero(ends)
        self.run_symbol = bwt[self.run_at]
        self.run_suffix = self.order[self.run_at]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix multiplication: as many ranks as fit 64 bits make the next key.

        0 stands for what is past the end.
        """
        n = len(text)
        used = np.flatnonzero(np.bincount(text, minlength=256))
        code = np.zeros(256, np.uint64)
        code[used] = np.arange(1, len(used) + 1)
        rank, top, width = code[text], len(used), 1
        while True:
            bits = np.uint64(int(top).bit_length())
            ways = 64 // int(bits)
            key = rank.copy()
            for k in range(1, ways):
                key <<= bits
                if k * width < n:
                    key[: n - k * width] |= rank[k * width :]
            width *= ways
            order = np.argsort(key)
            ranked = key[order]
            step = np.ones(n, np.uint64)
            step[1:] = ranked[1:] != ranked[:-1]
            np.cumsum(step, out=step)
            top = int(step[-1])
            if top == n or width >= n:
                return order
            rank = np.empty(n, np.uint64)
            rank[order] = step

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a[i] and b[i]."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        active = np.arange(len(a))
        while len(active):
            x, y = a[active] + out[active], b[active] + out[active]
            inside = (x < n) & (y < n)
            active, x, y = active[inside], x[inside], y[inside]
            differ = self.eight[x] ^ self.eight[y]
            same = differ == 0
            found = active[~same]
            if len(found):
                bytes_ = differ[~same].astype(">u8").view(np.uint8).reshape(-1, 8)
                out[found] += (bytes_ != 0).argmax(1)
            active = active[same]
            out[active] += 8
        return np.minimum(out, n - np.maximum(a, b))

    def matching_statistics(self) -> np.ndarray:
        """For every suffix the length of its longest match with any other suffix."""
        n = len(self.text)
        before = np.full(n, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        heads = self.run_suffix
        length = np.full(n, -1, np.int64)
        known = before[heads] >= 0
        length[heads[known]] = self._common(heads[known], before[heads[known]])
        length[heads[~known]] = 0
        # Inside a run the match is that of the suffix one byte earlier, less that byte.
        at = np.arange(n)
        source = np.maximum.accumulate(np.where(length >= 0, at, 0))
        length = np.maximum(length[source] - (at - source), 0)
        ordered = length[self.order]
        best = ordered.copy()
        best[:-1] = np.maximum(best[:-1], ordered[1:])
        out = np.empty(n, np.int64)
        out[self.order] = best
        return out


def repeated_starts(regions: list[bytes]) -> list[np.ndarray]:
    """Per region, which of its windows also occur elsewhere in these regions."""
    at = np.cumsum([0, *(len(r) + 1 for r in regions)])
    text = np.frombuffer(bytes([SEPARATOR]).join(regions) + bytes([SEPARATOR]), np.uint8)
    found = RunIndex(text).matching_statistics() >= LENGTH
    return [found[a : a + len(r) - LENGTH + 1] for a, r in zip(at[:-1], regions, strict=True)]


def _indexed(batches):
    """Rows sorted by fp -> intervals of the regions with m = 1; blocks hold whole anchors."""

    def done(held):
        out = [], [], [], []
        masks = repeated_starts([bytes(r["bytes"]) for r in held])
        for r, mask in zip(held, masks, strict=True):
            if r["m"] == 1 and mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    for column, v in zip(out, (r["fp0"], r["ctx0"], r["first"] + s, r["first"] + e - 1 + LENGTH), strict=True):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["fp", "ctx", "lo", "hi"])

    held, size = [], 0
    for b in batches:
        for r in b.to_pylist():
            if size > BLOCK and r["fp"] != held[-1]["fp"]:
                yield done(held)
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"])
    if held:
        yield done(held)


def _halved(level: int):
    """Rows of crowded anchors, divided into 2 ** level cells by distance from window to anchor."""
    cells = 1 << level
    edges = np.arange(cells + 1) * REACH // cells

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                data, place = r["bytes"], r["place"]
                far, nigh = place, place - (len(data) - LENGTH)  # of its first and last window
                for c in range(cells):
                    a, z = max(int(edges[c]), nigh), min(int(edges[c + 1]) - 1, far)
                    if a > z:
                        continue
                    shared = data[place - int(edges[c]) : place - int(edges[c + 1]) + 1 + LENGTH]
                    key = hashlib.blake2b(bytes([level, c]) + shared, digest_size=8).digest()
                    piece = data[place - z : place - a + LENGTH]
                    out.append((int.from_bytes(key, "little", signed=True), place - (place - z), piece, r["m"], r["fp0"], r["ctx0"], r["first"] + place - z))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fp", "place", "bytes", "m", "fp0", "ctx0", "first"])

    return run


ROW = "fp long, place int, bytes binary, m long, fp0 long, ctx0 long, first int"


def _slices(batches):
    for b in batches:
        out = []
        for text, wanted in zip(b["text"], b["wanted"].to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            out += [(w["fp"], w["place"], data[w["start"] : w["start"] + w["length"]], w["m"], w["fp"], w["ctx"], 0) for w in wanted]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fp", "place", "bytes", "m", "fp0", "ctx0", "first"])


def _index_matches(rows: DataFrame) -> DataFrame:
    """(fp, ctx, lo, hi): repeated stretches of regions, from the bytes of one region per class."""
    kind = "fp long, ctx long, lo int, hi int"
    found, levels = [], iter(LEVELS)
    rows = cut(rows)
    while True:
        crowded = cut(rows.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("fp"))
        if crowded.count() <= FEW:  # else both sides are shuffled
            crowded = F.broadcast(crowded)
        calm = rows.join(crowded, "fp", "left_anti")
        found.append(cut(together(calm, "fp").mapInArrow(_indexed, kind)))
        if crowded.isEmpty():
            break
        level = next(levels)  # after the last level a key is one window, which has one kind
        cells = cut(rows.join(crowded, "fp", "left_semi").mapInArrow(_halved(level), ROW).withColumn("h", F.xxhash64("bytes", "place")))
        kinds = cells.groupBy("fp", "h").agg(F.sum("m").alias("total"), F.min_by(F.struct("place", "bytes", "fp0", "ctx0", "first"), F.struct("fp0", "ctx0", "first")).alias("one"))
        kinds = cut(kinds)
        twice = cells.join(kinds.filter("total > 1").select("fp", "h"), ["fp", "h"], "left_semi")
        found.append(cut(twice.select(F.col("fp0").alias("fp"), F.col("ctx0").alias("ctx"), F.col("first").alias("lo"), (F.col("first") + F.length("bytes")).alias("hi"))))
        several = kinds.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
        rows = cut(kinds.join(several, "fp", "left_semi").select("fp", "one.place", "one.bytes", F.col("total").alias("m"), "one.fp0", "one.ctx0", "one.first"))
        release(rows.sparkSession)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _finish(batches):
    for b in batches:
        n, removed, count, digest = [], [], [], []
        for text, spans in zip(b["text"], b["spans"].to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            n.append(len(data))
            gone, pieces, at, runs = 0, [], 0, 0
            end = -1
            for s, e in sorted((x["lo"], x["hi"]) for x in spans or ()):
                if s > end:
                    if end >= 0:
                        at = end
                    pieces.append(data[at:s])
                    runs, gone, end = runs + 1, gone + e - s, e
                elif e > end:
                    gone, end = gone + e - end, e
            pieces.append(data[max(end, 0) :])
            removed.append(gone)
            count.append(runs)
            digest.append(hashlib.sha256(b"".join(pieces)).hexdigest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, spans) of the rows (key, text) that lose something; spans may overlap."""
    spark = texts.sparkSession
    prepare(spark)
    # What follows is narrow rows in large numbers; only this step and the last two see texts.
    every = cut(texts.mapInArrow(_anchor_rows, "fp long, ctx long, key long, start int, length int, place int"))
    several = every.groupBy("fp").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed")).filter("n > 1").select("fp", "mixed")
    found = cut(every.join(cut(several), "fp"))  # cut first, so that a very common anchor's side of the join can be split
    del every, several
    release(spark)

    classes = found.groupBy("fp", "ctx").agg(F.count("*").alias("m"), F.first("mixed").alias("mixed"), F.min(F.struct("key", "start", "length", "place")).alias("one"))
    classes = cut(classes)
    release(spark)
    wanted = classes.filter("mixed").select("one.key", F.struct("fp", "ctx", "m", "one.start", "one.length", "one.place").alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))
    prepare(spark, 200)
    rows = _fetched(texts, wanted)
    matches = _index_matches(rows)
    prepare(spark)
    release(spark)

    whole = found.join(classes.filter("m > 1").select("fp", "ctx"), ["fp", "ctx"], "left_semi").select("key", F.col("start").alias("lo"), (F.col("start") + F.col("length")).alias("hi"))
    part = found.join(matches, ["fp", "ctx"]).select("key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return cut(whole.unionByName(part).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))


def _fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of one region of each class."""
    return texts.join(wanted, "key").dropDuplicates(["key"]).select("text", "wanted").mapInArrow(_slices, ROW)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(texts.select("key", "text"))
    release(docs.sparkSession)
    prepare(docs.sparkSession, 500)
    out = texts.join(spans, "key", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
