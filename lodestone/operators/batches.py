"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

import pyarrow.compute as pc


def slices(batches, column: str = "text", rows: int = 2_048, size: int = 4_000_000):
    """Batches cut so that each has at most ``rows`` rows and, but for single longer texts, ``size`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and (i - at >= rows or total + n > size):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)
