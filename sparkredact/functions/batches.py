"""Arrow batches in runs of few rows, so that what Python holds doesn't grow with a partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a run, and bytes of it on average: Python objects take some ten times as much.
ROWS, BYTES = 512, 1 << 20


def runs(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
