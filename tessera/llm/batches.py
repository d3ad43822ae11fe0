"""Arrow batches of rows through Python functions, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that are handled at a time; one longer text is a slice of its own.
SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of at most ``most`` bytes of ``column``."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch[column]).to_pylist()):
        if size + (n or 0) > most and i > start:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def named(name: str) -> F.Column:
    """A column by its name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def give_back() -> None:
    """Hands freed memory to the system: Spark keeps workers for the next stage, with all that a task's arrays had taken."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # of glibc only
        trim(0)


def map_slices(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str | StructType, column: str = "text", most: int = SLICE) -> DataFrame:
    """fn gets the slices of a partition and yields columns by name, in the order of ``schema``."""
    schema = schema_of(schema) if isinstance(schema, str) else schema
    arrow, names = to_arrow_schema(schema), df.columns

    def run(batches):
        give_back()
        for columns in fn(part for batch in batches for part in slices(batch.rename_columns(names), column, most)):
            made = (columns[f.name] for f in arrow)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)
            del columns, made
        give_back()

    # by number: Spark would resolve a name with a dot or a backtick as something else
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


def texts(part: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; a null is an empty text."""
    return [x or "" for x in part[column].to_pylist()]
