"""Small helpers that the operators of this subpackage share."""

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words, and what is not it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 4_000_000


def words_column(text: Column | str) -> Column:
    """Number of words of a text as long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes (one row at least), so that Python's copies stay small."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_slices(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str
) -> DataFrame:
    """Apply work()(slice) -> columns to the rows of `df`; work() is called once per task."""
    names = [part.strip().split(" ")[0] for part in _fields(schema)]
    arrow = _arrow_schema(df, schema)

    def run(batches):
        one = work()
        for batch in batches:
            for part in slices(batch):
                columns = one(part)
                yield pa.RecordBatch.from_arrays(
                    [_array(columns[n], arrow.field(n).type) for n in names], schema=arrow
                )

    return df.mapInArrow(run, schema)


def _array(values, kind):
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _fields(schema: str) -> list[str]:
    depth, parts, last = 0, [], 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def process_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by its tasks.

    Only a memo of pure functions: losing it costs time, never a result. A worker keeps one: it outlives the operator
    it is for, and the memory of several would add up.
    """
    held = _memos()
    if name not in held:
        held.clear()
    return held.setdefault(name, {})


def release_memos() -> None:
    """Leave the memory of other operators' memos to a task that has none."""
    _memos().clear()


def _memos() -> dict[str, dict]:
    home = sys.modules.setdefault("_curvekit_memos", types.ModuleType("_curvekit_memos"))
    return home.__dict__.setdefault("held", {})
