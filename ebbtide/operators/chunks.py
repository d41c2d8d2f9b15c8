"""Arrow tables of whole groups, many groups at a time.

A task that called Python once per group would spend its time on the calls. Here rows come sorted by
group and a function gets as many whole groups as make up a chunk, to work on them in arrays.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 100_000     # rows of a chunk, about; a group with more is a chunk of its own


def firsts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group begins in a sorted table; a null key is a group too."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in keys:
        a, b = t.column(c).slice(1), t.column(c).slice(0, max(t.num_rows - 1, 0))
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy()
    return np.flatnonzero(new)


def whole_groups(each: Callable[[pa.Table, np.ndarray], pa.RecordBatch], keys: list[str]):
    """A `mapInArrow` function that calls `each(table, starts)`; the last group of a chunk waits for the next."""
    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            starts = firsts(t, keys)
            if len(starts) > 1:
                yield each(t.slice(0, starts[-1]), starts[:-1])
                t = t.slice(starts[-1])
            held, rows = t.to_batches(), 0                            # a long group waits for as many rows again
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        if t is not None and t.num_rows:
            yield each(t, firsts(t, keys))
    return run
