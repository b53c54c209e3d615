"""Candidate pairs in regions of a sorted order.

Rows (key, id) are range-partitioned and sorted by key, then id, so a very common key is
spread over partitions like any other. Rows whose keys agree in their first bytes form a
region. Small regions give all their pairs. Of others, which include those that a partition's
end may have cut, every row gives the pairs with the next ones in the order, where longer
common prefixes stand side by side, and comes out itself, so that the rest of the region's
pairs can be looked at block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SMALL, NEAR, LIMIT = 16, 3, 1 << 14


def chosen(item: np.ndarray, group: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each item its candidate in the least group, and the nearest one: indices."""
    out = []
    for order in (np.lexsort((far, group, item)), np.lexsort((group, far, item))):
        ranked = item[order]
        out.append(order[np.concatenate([[True], ranked[1:] != ranked[:-1]])])
    return np.concatenate(out)


def _pairs(codes: np.ndarray, prefix: int, open_start: bool, open_end: bool):
    """Index pairs (i < j) of neighbours, and which rows are of a large or an open region; codes are sorted."""
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:, :prefix] != codes[:-1, :prefix]).any(1)
    start = np.flatnonzero(new)
    size, of = np.diff(np.append(start, len(codes))), np.cumsum(new) - 1
    large = size > SMALL
    large[0] |= open_start
    large[-1] |= open_end
    large = large[of]
    left, right = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero((of[:-d] == of[d:]) & (~large[:-d] | (d <= NEAR)))
        if not len(i):
            break
        left.append(i)
        right.append(i + d)
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none]), large


def sorted_neighbours(rows: DataFrame, prefix: int) -> DataFrame:
    """From rows (key binary of one length, id long): pairs (a < b), and rows (a, region) of large regions.

    Memory is bounded: of a region of over ``LIMIT`` rows, only the last ``NEAR`` are held
    when the others are out.
    """

    def emit(codes, ids, done, open_start, open_end):
        """The first ``done`` rows are out already."""
        i, j, large = _pairs(codes, prefix, open_start, open_end)
        fresh = j >= done
        i, j = i[fresh], j[fresh]
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        large[:done] = False
        crowd = np.flatnonzero(large)
        region = pa.array([bytes(x) for x in codes[crowd, :prefix]], pa.binary())
        columns = [[pa.array(pairs[:, 0]), pa.array(ids[crowd])], [pa.array(pairs[:, 1]), pa.nulls(len(crowd), pa.int64())], [pa.nulls(len(pairs), pa.binary()), region]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], names=["a", "b", "region"])

    def run(batches):
        codes = ids = None
        done, first = 0, True  # first: the held rows begin with a region that may have begun in another partition
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.frombuffer(b"".join(batch["key"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            new_ids = batch["id"].to_numpy().astype(np.int64)
            codes = new if codes is None else np.concatenate([codes, new])
            ids = new_ids if ids is None else np.concatenate([ids, new_ids])
            last = (codes[:, :prefix] == codes[-1, :prefix]).all(1)
            cut = int(len(codes) - last.sum())
            if cut:
                yield emit(codes[:cut], ids[:cut], done, first, False)
                codes, ids, done, first = codes[cut:], ids[cut:], 0, False
            if len(codes) > LIMIT:
                yield emit(codes, ids, done, True, True)
                codes, ids, done, first = codes[-NEAR:], ids[-NEAR:], NEAR, True
        if codes is not None:
            yield emit(codes, ids, done, first, True)

    return rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long, region binary")


def exploded(rows: DataFrame, make, id_col: str = "id") -> DataFrame:
    """(key, id) rows: ``make(batch)`` gives the keys of a batch as bytes (tables, rows, width)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = make(batch)
            tables, n, width = keys.shape
            flat = np.ascontiguousarray(keys).reshape(-1, width)
            at = np.arange(len(flat) + 1) * width
            column = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([column, pa.array(np.tile(batch[id_col].to_numpy(), tables))], names=["key", "id"])

    return rows.mapInArrow(run, "key binary, id long")
