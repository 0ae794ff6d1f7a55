"""Arrays of .npy files and array dictionaries of .npz files as relations: a row for each entry of the first axis.

Spark lists and reads the files, so any file system of the cluster will do.  A
task holds one file's bytes and one block of decoded rows, or one whole array
where it is stored by columns.  Pickled objects are refused unread.
"""

from __future__ import annotations

import io
import math
import posixpath
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_BLOCK = 1 << 20  # values decoded at once
_ZIP = b"PK"


def blocks(f: BinaryIO, where: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of an array in .npy format, each row flattened; a scalar is one row, a vector has rows of one value."""
    try:
        version = np.lib.format.read_magic(f)
        shape, by_columns, dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](f)
    except (ValueError, KeyError) as e:
        raise ValueError(f"{where}: not an array in .npy format 1.0 or 2.0") from e
    if dtype.hasobject:
        raise ValueError(f"{where}: holds pickled objects, which are not read")
    if dtype.kind not in "biuf":
        raise ValueError(f"{where}: holds {dtype}, only numbers and booleans are read")
    n, wide = (shape[0], math.prod(shape[1:])) if shape else (1, 1)

    def read(rows: int) -> np.ndarray:
        want = rows * wide * dtype.itemsize
        content = f.read(want)
        if len(content) < want:
            raise ValueError(f"{where}: ends before its {n} rows do")
        return np.frombuffer(content, dtype)

    if by_columns:
        yield 0, read(n).reshape(shape, order="F").reshape(n, wide)
        return
    step = max(_BLOCK // max(wide, 1), 1)
    for at in range(0, n, step):
        rows = min(step, n - at)
        yield at, read(rows).reshape(rows, wide)


def scan_arrays(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(file, name, row, values) of every array under ``path``.

    file is the file's path, name the array's key in a .npz file and the
    file's name without its ending for a .npy file, row its place on the first
    axis from 0, values the rest of its axes in C order, as ``kind``.  A value
    that ``kind`` can't hold is an error, a NaN stays one.  An array without
    entries has no rows; arrays of equal names stay apart by file.
    """
    out = T._parse_datatype_string(f"file string, name string, row long, values array<{kind}>")
    arrow = to_arrow_schema(out)
    element = arrow.field("values").type.value_type

    def batch(file: str, name: str, at: int, rows: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(np.ascontiguousarray(rows).astype(rows.dtype.newbyteorder("="), copy=False).ravel()).cast(element)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
        columns = [pa.array([file] * len(rows)), pa.array([name] * len(rows)), pa.array(np.arange(at, at + len(rows)))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat, type=arrow.field("values").type)], schema=arrow)

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in files:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                file, f = file.as_py(), io.BytesIO(content.as_py())
                if f.getbuffer()[:2] != _ZIP:
                    for at, rows in blocks(f, file):
                        yield batch(file, posixpath.basename(file).removesuffix(".npy"), at, rows)
                    continue
                with zipfile.ZipFile(f) as held:
                    for entry in held.infolist():
                        with held.open(entry) as g:
                            for at, rows in blocks(g, f"{file}, {entry.filename}"):
                                yield batch(file, entry.filename.removesuffix(".npy"), at, rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, out)
