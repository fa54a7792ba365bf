"""Groups from a sorted stream of Arrow batches, without one Python call of Spark's per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of each run of equal keys. A run may span batches."""
    kept: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        cut = np.zeros(len(t) - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            cut |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(cut) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield _run(t, lo, hi, keys)
        kept = t.slice(edges[-1])
    if kept is not None:
        yield _run(kept, 0, len(kept), keys)


def _run(t: pa.Table, lo: int, hi: int, keys: list[str]) -> tuple[tuple, pa.Table]:
    g = t.slice(lo, hi - lo)
    return tuple(g.column(k)[0].as_py() for k in keys), g
