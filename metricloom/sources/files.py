"""Single files with a name of their own: CSV with a byte order mark, JSON arrays, one file for each key.

Spark writes the lines as parts of a staging folder, in the order asked for;
its commit keeps one attempt of each task, so a retried task leaves no double
rows.  Then the parts are joined into a hidden file beside the target by
copying bytes through a small buffer, and that file is renamed to the target:
readers see the old file or the whole new one.  A failure before the rename
leaves the target as it was and removes the staging folder.
"""

from __future__ import annotations

import json
import math
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = b"\xef\xbb\xbf"
_BUFFER = 1 << 20


@F.pandas_udf(T.StringType())
def _numbers(x: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else repr(float(v)) for v in x], dtype=object)


def _field(name: str, kind: T.DataType) -> Column:
    """A column as CSV text before quoting: shortest numbers, True and False, nested values as JSON; null is empty."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(c.isNull() | F.isnan(c), F.lit(None)).otherwise(_numbers(c.cast("double")))
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "True").otherwise(F.when(~c, "False"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def _quoted(text: Column) -> Column:
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines_column(df: DataFrame) -> Column:
    """Each row as a line of CSV of all columns."""
    fields = [_quoted(_field(f.name, f.dataType)) for f in df.schema.fields]
    # a line of one empty field is quoted, so that it is not a blank line
    return F.when(fields[0] == "", '""').otherwise(fields[0]) if len(fields) == 1 else F.concat_ws(",", *fields)


def csv_header(names: list[str]) -> str:
    return ",".join('"' + n.replace('"', '""') + '"' if any(x in n for x in '",\r\n') else n for n in names)


class _Files:
    """The file system of a path, as Spark sees it."""

    def __init__(self, df: DataFrame, path: str):
        self.jvm = df.sparkSession._jvm
        self.hadoop = self.jvm.org.apache.hadoop
        self.fs = self.path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())

    def path(self, x):
        return self.hadoop.fs.Path(x)

    def parts(self, folder) -> list:
        """Part files in the order of their tasks."""
        found = [s.getPath() for s in self.fs.listStatus(folder) if s.isFile() and s.getPath().getName().startswith("part-") and s.getLen()]
        return sorted(found, key=lambda p: p.getName())

    def joined(self, parts: list, target, before: bytes = b"", after: bytes = b"", cut: int = 0) -> None:
        """The parts behind each other as one file, the last one without ``cut`` bytes at its end; it takes the target's place at once."""
        hidden = self.path(f"{target.getParent()}/.{target.getName()}.{uuid.uuid4().hex}")
        out = self.fs.create(hidden)
        try:
            out.write(bytearray(before))
            for i, p in enumerate(parts):
                source = self.fs.open(p)
                try:
                    size = self.fs.getFileStatus(p).getLen() - (cut if i == len(parts) - 1 else 0)
                    bounded = self.jvm.org.apache.commons.io.input.BoundedInputStream(source, size)
                    self.hadoop.io.IOUtils.copyBytes(bounded, out, _BUFFER, False)
                finally:
                    source.close()
            out.write(bytearray(after))
            out.close()
            self.fs.delete(target, False)
            if not self.fs.rename(hidden, target):
                raise OSError(f"cannot rename {hidden} to {target}")
        finally:
            out.close()
            self.fs.delete(hidden, False)


def _staged(df: DataFrame, path: str, write: Callable[[str], None], finish: Callable[[_Files, str], None]) -> None:
    files = _Files(df, path)
    stage = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    try:
        write(stage)
        finish(files, stage)
    finally:
        files.fs.delete(files.path(stage), True)


def _ordered(df: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    return df.orderBy(*order) if order else df


def write_csv_file(df: DataFrame, path: str, *order: str | Column, bom: bool = True, newline: str = "\n") -> None:
    """One CSV file with a header, rows in the given order, in UTF-8 with or without a byte order mark.

    Nulls and NaN are empty, numbers the shortest text that reads back,
    nested values JSON.  An empty relation gives a header.
    """
    head = (BOM if bom else b"") + csv_header(df.columns).encode() + newline.encode()
    lines = _ordered(df, order).select(csv_lines_column(df).alias("line"))
    _staged(df, path, lambda at: lines.write.option("lineSep", newline).text(at), lambda f, at: f.joined(f.parts(f.path(at)), f.path(path), head))


def write_csv_files(df: DataFrame, folder: str, name: Column, *order: str | Column, bom: bool = True, newline: str = "\n") -> None:
    """One CSV file in the folder for each value of ``name``, in the given order; each takes the place of a file of its name.

    Rows without a name are an error.  One sort deals all files over the
    tasks, so a large one is written by several.
    """
    head = (BOM if bom else b"") + csv_header(df.columns).encode() + newline.encode()
    named = df.withColumn("file_", F.when(name.isNotNull(), name).otherwise(F.raise_error(F.lit("a row has no file name"))))
    sorted_rows = named.orderBy("file_", *order)
    lines = sorted_rows.select("file_", csv_lines_column(df).alias("line"))

    def finish(f: _Files, at: str) -> None:
        for s in f.fs.listStatus(f.path(at)):
            if s.isDirectory():
                file = urllib.parse.unquote(s.getPath().getName().removeprefix("file_="))
                f.joined(f.parts(s.getPath()), f.path(f"{folder.rstrip('/')}/{file}"), head)

    _staged(df, folder, lambda at: lines.write.partitionBy("file_").option("lineSep", newline).text(at), finish)


def json_text(value, decimals: int, indent: int, level: int) -> str:
    """A value as indented JSON, doubles rounded; containers are indented by their level, empty ones are not opened."""
    pad, end = "\n" + " " * indent * (level + 1), "\n" + " " * indent * level
    if isinstance(value, dict):
        return "{" + ",".join(f"{pad}{json.dumps(str(k))}:{json_text(v, decimals, indent, level + 1)}" for k, v in value.items()) + (end if value else "") + "}"
    if isinstance(value, list):
        return "[" + ",".join(pad + json_text(v, decimals, indent, level + 1) for v in value) + (end if value else "") + "]"
    if isinstance(value, float):
        text = f"{round(value, decimals) + 0.0:.{decimals}f}".rstrip("0")
        return text + "0" if text.endswith(".") else text
    return json.dumps(value).replace("/", "\\/")


def _finite(c: Column, kind: T.DataType) -> Column:
    """c with NaN and infinities as nulls, also within structs, arrays and maps."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(c) < float("inf"), c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, kind.valueType))
    return c


def write_json_array(df: DataFrame, path: str, *order: str | Column, decimals: int = 10, indent: int = 2) -> None:
    """One JSON file: an array of records in the given order, indented, doubles rounded to so many decimals.

    Nulls, NaN and infinities are null.  An empty relation gives an empty
    array.  Maps keep their order, structs that of their fields.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"line": [" " * indent + json_text(json.loads(x), decimals, indent, 1) for x in b["r"]]})

    record = F.struct(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    lines = _ordered(df, order).select(F.to_json(record, {"ignoreNullFields": "false"}).alias("r")).mapInPandas(texts, "line string")

    def finish(f: _Files, at: str) -> None:
        parts = f.parts(f.path(at))
        # each record ends in a comma and a line break, which the last one loses
        f.joined(parts, f.path(path), b"[\n" if parts else b"[", b"\n]" if parts else b"]", 2)

    _staged(df, path, lambda at: lines.write.option("lineSep", ",\n").text(at), finish)
