"""Row-wise operators as Arrow batches in, Arrow batches out, with state that lives per task."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Bytes of a batch that are turned into Python values at a time.
SLICE_BYTES = 2_000_000
_PLACE = "_nl_worker_state"


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """The object that ``make`` gives, kept by a Python worker from task to task.

    Functions travel by value, so a module of their own can't hold it. Only the object of the
    latest key is kept, which bounds the memory of a worker that many stages use.
    """
    holder = sys.modules.setdefault(_PLACE, ModuleType(_PLACE)).__dict__
    if holder.get("key") != key:
        holder.pop("value", None)
        holder["value"], holder["key"] = make(), key
    return holder["value"]


def give_back() -> None:
    """Return free memory to the system, as idle workers live on between stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_rows(df: DataFrame, start: Callable[[], Callable[[dict[str, list]], Iterator[dict[str, list]]]], schema: StructType, closing: bool = False) -> DataFrame:
    """Apply ``start()``, once per task, to each batch's columns as lists; it yields columns.

    Batches stay bounded: Spark cuts them by rows and bytes, and here they are cut again by bytes.
    With ``closing`` it is also applied to None, once after the last batch.
    """
    names = schema.fieldNames()
    arrow = to_arrow_schema(schema)

    def made(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            size = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield from map(made, step({n: part.column(n).to_pylist() for n in part.schema.names}))
        if closing:
            yield from map(made, step(None))
        del step
        give_back()

    return df.mapInArrow(run, schema)
