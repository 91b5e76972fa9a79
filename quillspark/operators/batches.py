"""Arrow passes that hold one text and one part of their rows at a time, whatever a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Rows that go on together, and characters of texts after which what is there goes on.
MOST_ROWS, MOST_CHARS = 20_000, 1_000_000


def in_parts(batches: Iterator[pa.RecordBatch], keys: int, of: Callable[..., Iterable[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that of() gives for each row of batches, behind its first columns (keys of them), which of() does not get.

    of()'s first argument is the text that its rows come from.
    """
    for b in batches:
        columns, at, rows, chars = b.columns[keys:], [], [], 0

        def part(b: pa.RecordBatch = b) -> pa.RecordBatch:
            own = [b.column(k).take(pa.array(at, pa.int64())).cast(schema.field(k).type) for k in range(keys)]  # noqa: B023
            return pa.RecordBatch.from_arrays(own + [pa.array([r[k] for r in rows], schema.field(keys + k).type) for k in range(len(schema) - keys)], schema=schema)  # noqa: B023

        for k in range(b.num_rows):
            args = [c[k].as_py() for c in columns]
            for r in of(*args):
                rows.append(r)
                at.append(k)
                if len(rows) == MOST_ROWS:
                    yield part()
                    at, rows = [], []
            chars += len(args[0] or "")
            if rows and chars > MOST_CHARS:
                yield part()
                at, rows, chars = [], [], 0
        if rows:
            yield part()
