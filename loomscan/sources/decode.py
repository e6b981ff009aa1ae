"""Typed values of tensor rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.functions.dtypes import DTYPES


def decode(tensors: DataFrame, dtype: str, values_col: str = "values") -> DataFrame:
    """The tensors of one element type without data, with their elements, flat and row-major, as an array. Arrays of a tensor without elements are empty."""
    found = DTYPES.get(dtype)
    if found is None or found.decode is None:
        raise ValueError(f"no typed values for dtype {dtype!r}")
    rows = tensors.filter(F.col("dtype") == dtype)
    names = [c for c in rows.columns if c not in ("data", values_col)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    fixed = {"F64": "<f8", "F32": "<f4", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1"}.get(dtype)
    exact = {"float": pa.float32(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_(), "decimal(20,0)": pa.decimal128(20, 0)}.get(found.spark, pa.struct([("re", pa.float32()), ("im", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            data = batch.column("data")
            if fixed and not data.null_count:  # bytes of all rows lie one after the other: elements are views of them
                _, places, held = data.buffers()
                ends = np.frombuffer(places, dtype=np.int32, count=len(data) + 1, offset=4 * data.offset)
                flat = np.frombuffer(held or b"", dtype=fixed, count=int(ends[-1] - ends[0]) // found.width, offset=int(ends[0]))
                values = pa.ListArray.from_arrays(pa.array((ends - ends[0]) // found.width, type=pa.int32()), pa.array(flat))
            else:
                values = pa.array([None if x is None else found.decode(x) for x in data.to_pylist()], type=pa.list_(exact))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], names=[*names, values_col])

    return rows.mapInArrow(run, f"{kinds}, `{values_col}` array<{found.spark}>")
