"""Arrow batches of sorted partitions, group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the first row of each; a group that is cut waits for its rest."""
    waiting: list[pa.RecordBatch] = []

    def taken() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return table, np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        if all(waiting[0].column(k)[0] == v for k, v in zip(keys, last)):
            continue  # one group so far, which may go on
        table, firsts = taken()
        yield table.slice(0, firsts[-1]), firsts[:-1]
        waiting = table.slice(firsts[-1]).to_batches()
    if waiting:
        yield taken()
