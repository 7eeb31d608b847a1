"""Arrow batches within a task, cut to a bounded number of bytes."""

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that a task works on at a time; a longer text goes alone.
BATCH_BYTES = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices whose values of a string or binary column stay within the bound."""
    for batch in batches:
        sizes = [len(value.as_buffer()) if value.is_valid else 0 for value in batch.column(column)]
        start = held = 0
        for at, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
