"""Arrow columns to Python and back, for functions given to mapInArrow."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return pc.fill_null(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()), b"").to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rows(**named) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in named.values()], names=list(named))


def unused(df, name: str) -> str:
    """A name like `name` that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released() -> None:
    """Give what this worker has freed back to the system: workers are reused, and others need the memory meanwhile."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
